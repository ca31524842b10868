"""Intermediate tables in the shared folder; see ``demolake.sources.shared``."""

from demolake.sources.shared import delete, materialize, new_folder, shared_dir, stored, temporary_tables

__all__ = ["delete", "materialize", "new_folder", "shared_dir", "stored", "temporary_tables"]
