"""The pipeline against plain code over the same rows."""

import re

import numpy as np
import pyarrow as pa
from test_filters import SPACE, brute_counts
from test_search import brute_components

import corpus_pipeline
from quire.llm import packing, pii, quality, stages, tokens, toxicity


def kept_by_rules(text, rules):
    """The base rules and a learned list, on a text's own counts."""
    n, chars, symbols, dup, repeats, failed = brute_counts(text)
    words, lines = re.findall(SPACE, text), [x for x in text.split("\n") if re.search(SPACE, x)]
    value = {
        "words": n, "word_length": chars / max(n, 1), "symbols_per_word": symbols / max(n, 1), "dup_line_share": dup / max(len(lines), 1), "repeat_share": repeats / max(n, 1),
        "words_per_distinct": n / max(len(set(words)), 1), "marks_per_word": len(re.findall("[!?]", text)) / max(n, 1), "upper_share": len(re.findall("[A-ZÀ-ÖØ-Þ]", text)) / max(chars, 1),
    }
    covered = any(all((value[c.name] >= c.value) == c.above for c in rule) for rule in rules.rules)
    return not failed and not covered


def is_toxic(text, model):
    weight = dict(zip(model.feature.tolist(), model.weight.tolist()))
    words = sorted(set(re.findall(SPACE, text)))
    found = set(toxicity._hashes(pa.array(words))[0].tolist()) if words else set()
    return model.bias + sum(weight.get(f, 0) for f in found) >= 0


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stages.stored(stage(spark, before, sf), name)
        assert after.columns == columns, name
        old, new = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in after.collect()}
        assert set(new) <= set(old) and new, name
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        if name == "quality_rules":
            rules = quality.fit(before, labels)
            want = {d for d, t in old.items() if kept_by_rules(t, rules)}
        elif name == "toxicity":
            model = toxicity.fit(before, labels)
            want = {d for d, t in old.items() if not is_toxic(t, model)}
        elif name == "near_dedup":
            want = {d for d, _, _, kept in brute_components(sorted(old.items())) if kept}
        else:
            want = set(old)
            assert all(new[d] == t for d, t in old.items() if not pii.find(t)[1]) and not any(pii.base(t) for t in new.values())
            for d, t in old.items():  # what stands outside the spans stands in the new text, in order
                at, rest = 0, new[d]
                for _, a, b in sorted(pii.find(t)[1], key=lambda x: x[1:]):
                    assert t[at:a] in rest
                    rest, at = rest[rest.index(t[at:a]) + max(a - at, 0) :] if a > at else rest, max(at, b)
        assert set(new) == want, name
        before = after
    packed = stages.packing(spark, before, sf).collect()
    tokenizer = tokens.load(tokens.vocabulary("byte_bpe_50k.json"))
    joined = {}
    for p in sorted(packed, key=lambda p: p["start"]):
        joined[p["doc_id"]] = joined.get(p["doc_id"], b"") + p["ids"]
    assert joined == {r["doc_id"]: np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes() for r in before.collect()}


def test_stages_on_odd_and_empty_tables(spark, odd, empty, sf):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns
        assert stage(spark, empty, sf).count() == 0
    assert stages.packing(spark, empty, sf).count() == 0
