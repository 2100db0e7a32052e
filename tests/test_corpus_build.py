import json

import pytest

from quernlake.operators import markdown
from quernlake.sources import corpus, corpus_build
from quernlake.sources.payments import SourceError

MIRROR = """Original link: https://docs.example.org/guides/sample/

# Sample guide

Text with a [link](../other/).

## SDK

```json
{"port": 80, "python": {"version": "3.12"}}
```

## SDK

Connect with mysql://user:hunter22secret@db.example/x.

```sh
#!/usr/bin/python3
mysql -u root --password=topsecret1 -phunter2
```

## Create a database

Use a small plan for it.

## No anchor here

```{bash}
TOKEN Ab3dE5gH7jK9mN1pQ3sT5vW7yZ
```

## All links
[gone](x)
"""
COMPONENT = """<Layout><Section id="first-sdk" title="SDK"><p>x</p></Section>
<Section id="second-sdk" title="SDK"></Section>
<Section id="make" title="Create a database"><p>Use a small plan</p><Asciinema id="demo" /></Section></Layout>"""


@pytest.fixture
def root(tmp_path):
    for folder in (corpus_build.MIRROR, corpus_build.COMPONENTS, corpus_build.CASTS):
        (tmp_path / folder / "guides").mkdir(parents=True)
    (tmp_path / corpus_build.MIRROR / "guides/sample.md").write_text(MIRROR)
    (tmp_path / corpus_build.COMPONENTS / "guides/sample.mdx").write_text(COMPONENT)
    return tmp_path


def test_build_corpus(spark, root):
    commands = spark.createDataFrame([("demo", 0, "db create --plan=small --public-network")], "cast_id string, ord int, command string")
    made = corpus_build.build_corpus(spark, str(root), str(root / "out"), commands, "abc1234", "abc")
    rows = corpus.read_records(spark, str(root / "out/corpus")).collect()
    by = {r.heading_path[-1] + str(i): r for i, r in enumerate(sorted(rows, key=lambda r: (r.anchor or "", r.id)))}
    assert {r.anchor for r in rows} == {None, "first-sdk", "second-sdk", "make"} and len(by) == len(rows)
    assert all(r.commit == "abc1234" and r.path == "guides/sample" for r in rows)
    made_row = next(r for r in rows if r.anchor == "make")
    assert [(b.lang, b.source) for b in made_row.code_blocks] == [("bash", "cast")] and "db create --plan=small" in made_row.text
    langs = {b.lang for r in rows for b in r.code_blocks}
    assert langs == {"json", "bash"}
    counts = {}
    for r in made.redactions.collect():
        counts[r.shape] = counts.get(r.shape, 0) + r.n
    assert counts == {"high_entropy": 1, "password_flag": 2}  # prose is told apart from code: only fences are counted
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(str(root / "out/manifest")).collect()))
    assert set(manifest) == {"port", "python.version"}
    one = made.summary.first()
    assert (one.pages, one.chunks, one.with_casts) == (1, len(rows), 1)


def test_layout_and_commit(spark, root):
    with pytest.raises(SourceError, match="src/pages"):
        corpus_build.check_layout(spark, str(root / "public"))
    with pytest.raises(SourceError, match="not at abc"):
        corpus_build.build_corpus(spark, str(root), str(root / "out"), commit="fff", expected="abc")
    (root / corpus_build.COMPONENTS / "guides/lone.mdx").write_text("x")
    with pytest.raises(SourceError, match="lone"):
        corpus_build.build_corpus(spark, str(root), str(root / "out"))


def test_languages():
    shell = markdown.shell_pattern()
    assert markdown.sniff_language("", "\n  #!/usr/bin/python3\nx", shell) == "bash"
    assert markdown.sniff_language("{json}", "{not json", shell) == "text"
    assert markdown.sniff_language("{yml}", "a: 1", shell) == "yaml"
    assert markdown.sniff_language("js", '{"a": 1}', shell) == "json"
    assert markdown.sniff_language("", "npm  install", shell) == "bash" and markdown.sniff_language("", "npmx", shell) == "text"
