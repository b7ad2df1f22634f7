"""Base scores need no pieces: they are those of op5, made without its lattice."""

import pytest

import __spark_entry__ as entry
from phenolith.llm import lm_score

SMALL = "/root/testdata/sf0.001"


def test_base_scores_come_without_a_lattice(spark, monkeypatch):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    whole = {r["doc_id"]: r for r in entry.queries()["op5_lm_scoring"](spark, SMALL).collect()}
    monkeypatch.setattr(lm_score, "vocabulary", lambda path: pytest.fail("no pieces are asked for"))
    base = {r["doc_id"]: r for r in entry.queries()["lm_base"](spark, SMALL).collect()}
    assert base.keys() == whole.keys() and all(base[i][n] == whole[i][n] for i in base for n in names)
    assert all(abs(base[i]["base_score"] - whole[i]["base_score"]) < 1e-4 for i in base)
