"""op4 and the pipeline's third stage: runs that very many texts hold."""

import random
from collections import Counter

from metaspan.llm import suffix_dedup

LENGTH, TEXTS = 200, 300


def _joined(plan) -> int:
    """Rows that the joins of an executed plan have made."""
    name, inner = plan.nodeName(), []
    if name == "AdaptiveSparkPlan":
        inner = [plan.executedPlan()]
    elif name.endswith("QueryStage"):
        inner = [plan.plan()]
    else:
        inner = [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in name else 0
    return own + sum(map(_joined, inner))


def test_a_passage_of_very_many_texts(spark, monkeypatch):
    """Results are those of brute force, and no join makes a row per text and run."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    rng = random.Random(5)
    fresh = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    passage, few = fresh(3000), fresh(500)
    texts = [fresh(40) + passage + fresh(250) + (few if k % 100 == 0 else "") for k in range(TEXTS)] + [passage[:900]] * 30 + [fresh(700), "", None]
    made = []

    def seen(df, name, keep=suffix_dedup.written):
        out = keep(df, name)
        if name == "spans":
            df.collect()
            made.append(_joined(df._jdf.queryExecution().executedPlan()))
        return out

    monkeypatch.setattr(suffix_dedup, "written", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(docs, LENGTH).collect()}
    count = Counter(t[i : i + LENGTH] for t in texts if t for i in range(len(t) - LENGTH + 1))
    for k, t in enumerate(texts):
        left, end = "", 0
        for i, c in enumerate(t or ""):
            if count[t[i : i + LENGTH]] > 1 and i + LENGTH <= len(t):
                end = i + LENGTH
            left += c if i >= end else ""
        assert got[k] == left
    assert made and made[0] < TEXTS
