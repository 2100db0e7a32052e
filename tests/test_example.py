"""The example script, run as its users do, on records of this test."""

import importlib.util
import json
import os

from quernlake.schemas import CHUNKS

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_retrieval_example(spark, tmp_path):
    spec = importlib.util.spec_from_file_location("retrieve_example", os.path.join(ROOT, "examples", "retrieve.py"))
    example = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(example)
    texts = {"a": "deploy a django app", "b": "disks and volumes", "c": "deploy from a container"}
    path = tmp_path / "corpus.jsonl"
    with path.open("w") as f:
        for key, text in texts.items():
            record = {"id": key, "path": f"p/{key}", "url": f"https://e.org/{key}", "anchor": None, "cite_url": f"https://e.org/{key}#x", "heading_path": ["H"], "lang": "en", "text": text, "text_norm": text, "code_blocks": [], "token_estimate": 5, "commit": "c"}
            assert list(record) == CHUNKS.names
            f.write(json.dumps(record) + "\n")
    told = example.run(spark, str(path), "how do I deploy django", str(tmp_path / "vectors"), 2)
    assert told["loaded_records"] == told["embedded_chunks"] == 3 and [r["id"] for r in told["results"]][0] == "a" and len(told["results"]) == 2
    assert example.run(spark, str(path), "disks", str(tmp_path / "vectors"))["embedded_chunks"] == 0
