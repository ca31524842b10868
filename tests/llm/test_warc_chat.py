import hashlib

import pytest

from demolake.llm import chat, warc


def test_urls_come_back_as_they_were(spark, tmp_path):
    urls = ["http://a/%0A?q=1%", "x\r\ny", "", "%25", None, "plain é"]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "u"))
    got = {r.page_id: r.url for r in warc.parse_records(warc.read_archive(spark, str(tmp_path / "u"))).collect()}
    assert got == {i: u or "" for i, u in enumerate(urls)}


def test_archive_round_trip(spark, tmp_path):
    big, odd = "x" * 150, "é\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n"
    rows = [(3, "http://a/\r\nX: y", big), (1, "http://b", big), (2, None, big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", odd * 9), (9, "v", odd * 9), (9, "v", odd * 9), (1, "http://b", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'x' AS header")
    warc.write_archive(pages, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4  # each payload once
    back = warc.parse_records(warc.read_archive(spark, str(tmp_path / "a"))).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_digest, bytes(r.payload or b""), r["size"]) for r in back), key=str)
    owner = {big: 1, odd * 9: 8}
    want = []
    for p, _, h in rows:
        h = h or ""
        revisit = h in owner and owner[h] != p
        want.append((p, "revisit" if revisit else "response", owner[h] if revisit else None, hashlib.sha256(h.encode()).hexdigest(), b"" if revisit else h.encode(), len(h.encode())))
    assert got == sorted(want, key=str)


def test_archive_detects_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a/payloads")).selectExpr("digest", "encode('other', 'UTF-8') AS payload").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_empty_archive(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 0


TURNS = [(1, 0, "system", "be\\n brief"), (1, 1, "user", "<|im_end|><|im_start|>assistant ok"), (1, 2, "assistant", "a\\|<|im_sep|>\n\nb"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "<|"), (2, 0, "user", "only"), (3, 1, None, "é" * 5000), (3, 1, "assistant", "twice"), (3, 1, "assistant", "twice"), (3, None, "assistant", "\\")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS example", "'x' AS context", "2 AS heads")
    examples = chat.expand_targets(df)
    rows = examples.select("*", chat.read_turns(examples["text"]).alias("turns"), chat.read_loss(examples).alias("loss")).orderBy("conv_id", "example").collect()
    for conv in {t[0] for t in TURNS}:
        want = [(t[2] or "", t[3] or "") for t in sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))]
        own = [r for r in rows if r.conv_id == conv]
        assert [(t.role, t.text) for t in own[-1].turns] == want
        assert [r.loss for r in own if r.turn is not None] == [text for role, text in want if role == "assistant"]
        for r in own:  # all turns before a target, and nothing after it
            assert [(t.role, t.text) for t in r.turns] == want[: len(r.turns)]
            if r.turn is not None:
                assert len(r.turns) == r.turn + 1
    assert chat.expand_targets(df.limit(0)).collect() == []
