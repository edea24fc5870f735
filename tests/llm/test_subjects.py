import random

import numpy as np

from panelmill.llm.subjects import accepted, calibrate, classify, fit, judged, labelled_sample, shares, train

AREAS = ["law", "sport", "science"]
WORDS = {s: [f"{s}{i}ово" for i in range(12)] for s in AREAS}
COMMON = [f"общее{i}" for i in range(12)]


def sentence(s, r):
    return " ".join(r.choices(COMMON, k=5) + (r.choices(WORDS[s], k=9) if s else [])) + "."


def corpus(n=500, seed=0):
    r = random.Random(seed)
    docs, truth, labels = [], {}, []
    for d in range(n):
        mine = r.sample(AREAS, r.choice([1, 1, 2]))
        parts = [sentence(r.choice(mine), r) for _ in range(12)]
        counts = {s: sum(WORDS[s][0][:3] in p for p in parts) for s in AREAS}
        parts += [sentence(None, r) for _ in range(4)]
        if d % 3 == 0:
            parts.append(sentence(r.choice([a for a in AREAS if a not in mine]), r))
        docs.append((d, " ".join(parts), "x"))
        truth[d] = {s for s in mine if counts[s] >= 0.2 * (12 + (d % 3 == 0))}
        if d % 3 == 1:
            labels += [(d, r.choice(AREAS) if r.random() < 0.1 else s, "ann") for s in mine[: r.choice([1, 2])]]
    return docs + [(9001, None, ""), (9002, "", ""), (9003, " ".join(COMMON) + ".", ""), (9004, sentence("law", r) * 3000, "")], truth, labels


def test_held_out_accuracy_and_edge_rows(spark):
    docs, truth, labels = corpus()
    found = classify(spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame(labels + labels[:4], "doc_id long, subject string, annotator string"), spark.createDataFrame([(a,) for a in AREAS], "subject string")).collect()
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert len(found) == sum(map(len, got.values())) and got.pop(9004) == {"law"}
    assert not set(got) & {9001, 9002, 9003}
    both = sum(len(got.get(d, set()) & t) for d, t in truth.items())
    assert both / sum(map(len, truth.values())) > 0.97 and both / sum(map(len, got.values())) > 0.97


def test_without_labels_or_documents(spark):
    docs, _, labels = corpus(30)
    d, lab, a = spark.createDataFrame(docs, "doc_id long, text string, s string"), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), spark.createDataFrame([(x,) for x in AREAS], "subject string")
    assert classify(d, lab.limit(0), a).count() == 0 and classify(d.limit(0), lab, a).count() == 0 and classify(d, lab, a.limit(0)).count() == 0


def test_acceptance_and_empty_model():
    n = np.array([[4.0, 1, 0], [3, 1, 1], [0, 0, 0], [1, 1, 1]])
    assert accepted(n, 0.2, 2).tolist() == [[True, True, False], [True, True, False], [False] * 3, [True, True, False]]
    m = fit([], AREAS, 0.2, 3)
    assert shares(m, ["что угодно"]).sum() == 0


def test_margins_are_calibrated_and_a_margin_is_per_token():
    docs, truth, labels = corpus()
    by = {}
    for d, s, _ in labels:
        by.setdefault(d, set()).add(s)
    rows = [(t, by[d]) for d, t, _ in docs if d in by]
    m = train(rows[::2], AREAS)
    margins = calibrate(m, rows[1::2], 0.2, 3)
    assert len(margins) == 3 and (margins >= 1).all() and (margins <= 9).all()
    doc, best, gained, n = judged(m, [t for _, t, _ in docs[:40]])
    assert np.allclose((gained * n)[n > 0] > 4, (gained > 4 / np.maximum(n, 1))[n > 0])


def test_the_sample_is_bounded_in_documents_and_characters(spark):
    docs = spark.createDataFrame([(i, "слово " * (10_000 if i == 3 else 10)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "law") for i in range(60)], "doc_id long, subject string")
    assert len(labelled_sample(docs, labels, "doc_id", "text", AREAS, 20, 10**9)) == 20
    assert sum(len(t) for t, _ in labelled_sample(docs, labels, "doc_id", "text", AREAS, 60, 2000)) <= 2000
