import json

import pytest

from quernlake.sources import corpus
from quernlake.sources.payments import SourceError

RECORD = {"id": "p#a:0", "path": "p", "url": "u", "anchor": None, "cite_url": "u#a", "heading_path": ["H"], "lang": "fa", "text": "t", "text_norm": "t", "code_blocks": [{"lang": "bash", "source": "fence", "text": "x"}], "token_estimate": 4, "commit": "c"}


def test_records(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text(json.dumps(RECORD) + "\n\n" + json.dumps({**RECORD, "id": "q"}) + "\n")
    rows = corpus.read_records(spark, str(path))
    assert rows.count() == 2 and rows.first().code_blocks[0].lang == "bash"
    out = str(tmp_path / "out")
    corpus.write_records(rows, out)
    assert corpus.read_records(spark, out).count() == 2
    path.write_text(json.dumps({**RECORD, "extra": 1}))
    with pytest.raises(Exception, match="not a corpus record"):
        corpus.read_records(spark, str(path)).collect()


def test_pages(spark, tmp_path):
    for root, suffix in (("a", "md"), ("b", "mdx")):
        (tmp_path / root / "x").mkdir(parents=True)
        (tmp_path / root / "x" / f"p.{suffix}").write_text("text\nmore")
    (tmp_path / "a" / "lone.md").write_text("x")
    mirror, parts = corpus.read_pages(spark, str(tmp_path / "a")), corpus.read_pages(spark, str(tmp_path / "b"), "*.mdx")
    assert {r.path for r in mirror.collect()} == {"x/p", "lone"} and parts.first().text == "text\nmore"
    with pytest.raises(SourceError, match="lone"):
        corpus.paired(mirror, parts)
    assert corpus.paired(mirror, parts, ("lone",))[0].count() == 1


def test_casts(spark):
    cast = '{"version": 2, "width": 80, "height": 24}\n[0.1, "o", "a"]\nbad\n[0.2, "i", "x"]\n[0.3, "o", "b"]'
    df = spark.createDataFrame([(cast,)], "t string")
    assert df.select(corpus.read_cast("t").alias("c")).first().c.output == "ab"
    bad = spark.createDataFrame([('{"width": 0}',)], "t string")
    with pytest.raises(Exception, match="no valid header"):
        bad.select(corpus.read_cast("t")).collect()
