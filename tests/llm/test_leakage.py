import random

import numpy as np
import pytest

from panelmill.llm.leakage import align, find_leaks
from panelmill.llm.text import skeleton, words

VOCAB = ["".join(random.Random(i).choices("абвгдежзиклмнопрст", k=7)) for i in range(4000)]
OPEN = "Прочитайте отрывок и ответьте на вопрос выбрав один верный вариант из четырёх предложенных. "


def disguise(ws, r):
    out = []
    for w in ws:
        k = r.random()
        if k < 0.3:
            w = w.translate(str.maketrans("аеоср", "aeocp"))
        elif k < 0.4:
            w = f"<b>{w}</b>"
        elif k < 0.5:
            w = w[:3] + "­" + w[3:]
        elif k < 0.6:
            w = w.upper()
        out.append(w)
    return out


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(5)
    items = [(i, "b", (OPEN if i % 3 == 0 else "") + " ".join(r.choices(VOCAB, k=80)), f"ответ {i}") for i in range(40)] + [(90, "b", None, None), (91, "b", "", "x")]
    docs, want = [], set()
    for d in range(400):
        ws = r.choices(VOCAB, k=r.randint(30, 300))
        if d % 4 == 0:
            i = r.randrange(40)
            src = items[i][2].replace(OPEN, "").split()
            n = r.choice([8, 14, 24, 40, 80])
            s = r.randrange(0, 81 - n)
            part = src[s : s + n]
            for k in range(n):
                if k % 9 == 4:
                    part[k] = r.choice(VOCAB)
            at = r.randrange(len(ws))
            ws[at:at] = disguise(part, r)
            if n >= 24:
                want.add((d, i))
        if d % 4 == 1:
            ws[3:3] = OPEN.split()
        docs.append((d, " ".join(ws), d))
    docs += [(900, None, 1), (901, "", 1), (902, " \n", 1), (903, "слово " * 60_000, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, bench string, text string, answer string"), want


def test_finds_disguised_passages_and_nothing_else(case):
    docs, items, want = case
    rows = [(r["doc_id"], r["item_id"]) for r in find_leaks(docs, "doc_id", "text", items).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_passes_do_not_change_the_result(case):
    docs, items, want = case
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, "doc_id", "text", items, items_per_pass=15).collect()} == want


def test_empty_sides(case):
    docs, items, _ = case
    assert find_leaks(docs.limit(0), "doc_id", "text", items).count() == 0
    assert find_leaks(docs, "doc_id", "text", items.limit(0)).count() == 0


def test_alignment():
    a = np.array([[*range(10, 40), -2, -2]])
    b = np.array([[1, 2, *range(12, 20), 99, *range(21, 30), 5, 6, 7, 8, -1, -1]])
    spans, other, same = align(a, b)
    assert (spans[0], other[0], same[0]) == (18, 18, 17)


def test_words_have_one_spelling():
    assert [skeleton(w) for w in words("Вода&nbsp;<i>тОпь</i> э­то")] == [skeleton(w) for w in words("вoдa топь это")]


def test_short_leaks_in_hosts_of_the_items_own_words(spark):
    r = random.Random(11)
    texts = [r.choices(VOCAB, k=80) for _ in range(40)]
    known = [w for t in texts for w in t]
    docs, want = [], set()
    for d in range(300):
        ws, i = r.choices(known, k=r.randint(60, 200)), r.randrange(40)
        n = r.choice([14, 20, 20, 21, 22, 23])
        s = r.randrange(0, 81 - n)
        part = texts[i][s : s + n]
        for k in [(), (9,), (1, n - 2), (0, 8), (2, n - 1)][d % 5] if n >= 20 else ():
            part[k] = "иное"
        at = r.randrange(len(ws))
        ws[at:at] = part
        docs.append((d, " ".join(ws)))
        if n >= 20:
            want.add((d, i))
    items = spark.createDataFrame([(i, " ".join(t), "") for i, t in enumerate(texts)], "item_id long, text string, answer string")
    got = {(x["doc_id"], x["item_id"]) for x in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", items).collect()}
    assert got == want


def test_long_items_long_leaks_and_paraphrases(spark):
    import random

    r = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in "бвгдж" for b in "аеиоу" for c in ("рон", "лик", "мец", "тан", "сук", "веш", "дол", "пир")]
    text = lambda n: " ".join(r.choices(vocab, k=n) if n < 50 else [r.choice(vocab) + str(r.randint(0, 40)) for _ in range(n)])
    long_item, short = text(17_000).split(), text(60).split()
    answer = "верный ответ семь"
    near = short[:30]
    for k in range(3, 30, 4):
        near[k] = f"иное{k}"
    docs = [(1, text(300) + " " + " ".join(long_item[16_500:16_540]) + " " + text(300)), (2, text(100) + " " + " ".join(long_item[200:500]) + " " + text(100)), (3, text(90) + " " + " ".join(near) + " " + answer + " " + text(90)), (4, text(90) + " " + " ".join(near) + " " + text(90)), (5, text(400))]
    items = spark.createDataFrame([(10, "b", " ".join(long_item), "нет"), (11, "b", " ".join(short), answer)], "item_id long, bench string, text string, answer string")
    got = {(x["doc_id"], x["item_id"]): x for x in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", items).collect()}
    assert {k for k, v in got.items() if v["kind"] == "passage"} == {(1, 10), (2, 10)}
    assert abs(got[1, 10]["span"] - 40) <= 4 and abs(got[2, 10]["span"] - 300) <= 10
    assert (4, 11) not in got and ((3, 11) not in got or got[3, 11]["kind"] == "paraphrase") and (3, 11) in got


def test_quick_and_plain_subsequence_agree():
    import numpy as np

    from panelmill.llm.leakage import common_subsequence, quick_subsequence

    rng = np.random.default_rng(0)
    a, b = rng.integers(-2, 8, (300, 24)), rng.integers(-2, 8, (300, 48))
    assert (quick_subsequence(a, b) == common_subsequence(a, b)).all()
