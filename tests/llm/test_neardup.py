import random
import re

from pyspark.sql import functions as F

from panelmill.llm.neardup import components, link_counts, linking_pairs, near_groups, near_pairs, signed_classes, similar_classes, verified, word_classes, words


def corpus(seed=0):
    r = random.Random(seed)
    vocab = [f"слово{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = r.sample(vocab, r.randint(8, 60))
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            t = base[:]
            for _ in range(r.randint(0, max(1, len(t) // 12))):
                t[r.randrange(len(t))] = r.choice(vocab)
            r.shuffle(t)
            texts.append(", ".join(t).upper())
    return [(i, t) for i, t in enumerate(texts)] + [(900, texts[0]), (901, None), (902, ""), (903, " ?! "), (904, "слово1 " * 20_000)]


def brute(rows, threshold):
    s = {i: set(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows}
    ids = sorted(i for i in s if s[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}


def test_pairs_and_groups_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + rows[:3], "id long, text string")
    members, classes = word_classes(df, "id", words(F.col("text")))
    signed = signed_classes(classes, 72, 6)
    close = similar_classes(signed, 0.6)
    got = [(r["a"], r["b"]) for r in near_pairs(members, close).collect()]
    want = brute(rows, 0.6)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want - set(got)) <= 0.02 * len(want)
    groups = {r["item"]: r["group_id"] for r in near_groups(members, linking_pairs(signed, 0.6)).collect()}
    assert groups == {r["item"]: r["group_id"] for r in near_groups(members, close).collect()}
    links = {r["item"]: r["n_links"] for r in link_counts(members, close).collect()}
    text = {i: frozenset(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows}
    assert all(links[i] == len({text[b if a == i else a] for a, b in got if i in (a, b)} - {text[i]}) for i in links)
    assert set(groups) == {i for i, t in rows if re.search(r"[^\W_]", t or "")}
    assert all(groups[a] == groups[b] for a, b in got) and groups[0] == groups[900] == 0


def test_hot_class_and_empty(spark):
    df = spark.createDataFrame([(i, "один и тот же заголовок") for i in range(40)] + [(99, "совсем другое дело")], "id long, text string")
    members, classes = word_classes(df, "id", words(F.col("text")))
    assert classes.count() == 2 and members.count() == 41
    close = similar_classes(signed_classes(classes, 20, 4), 0.6)
    assert near_pairs(members, close).count() == 40 * 39 / 2
    members, classes = word_classes(df.limit(0), "id", words(F.col("text")))
    assert near_pairs(members, similar_classes(signed_classes(classes, 20, 4), 0.6)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(41)) and all(roots[k] == 100 for k in range(100, 130))


def test_headline_pairs_near_the_threshold_are_not_missed(spark, monkeypatch):
    from panelmill.llm import neardup, queries

    n, rows = 20_000, []
    for i in range(n):  # 26 words in both of 40: similarity 0.65
        w = [f"п{i}с{k}" for k in range(40)]
        rows += [(2 * i, " ".join(w[:33])), (2 * i + 1, " ".join(w[:26] + w[33:]))]
    df = spark.createDataFrame(rows, "shock_id long, `заголовки` string")
    monkeypatch.setattr(queries, "read_table", lambda *a: df)
    found = queries.p3_found(spark, "").where("shock_b = shock_a + 1 and shock_a % 2 = 0").count()
    assert n - found <= 0.002 * n


def test_a_tight_group_is_linked_without_all_its_pairs(spark, monkeypatch):
    from panelmill.llm import neardup

    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base + [f"own{i}"])) for i in range(150)] + [(1000 + i, " ".join(f"z{i}x{j}" for j in range(30))) for i in range(50)]
    members, classes = word_classes(spark.createDataFrame(rows, "id long, text string"), "id", words(F.col("text")))
    compared = []
    monkeypatch.setattr(neardup, "verified", lambda pairs, *a: (compared.append(pairs.count()), verified(pairs, *a))[1])
    groups = {r["item"]: r["group_id"] for r in near_groups(members, linking_pairs(signed_classes(classes, 90, 6), 0.6)).collect()}
    assert {groups[i] for i in range(150)} == {0} and all(groups[1000 + i] == 1000 + i for i in range(50))
    assert sum(compared) < 150 * 149 / 8


def test_a_long_chain_is_followed_to_its_end(spark):
    roots = {r["root"] for r in components(spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long")).collect()}
    assert roots == {0}
