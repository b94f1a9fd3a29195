"""Cases that a shorter search or a coarser test would lose."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import language_id, near_dedup, secret_scan, suffix_dedup, topk_search


def edited(r: random.Random, words: list[str], name: str, edits: int = 3) -> str:
    out = list(words)
    for k, at in enumerate(r.sample(range(len(out)), edits)):
        out[at] = f"{name}e{k}"
    return " ".join(out)


def test_near_dedup_links_stars_and_chains(spark):
    """Copies that are like their original, or the one before them, but mostly not like each other, are one class."""
    r = random.Random(17)
    star, link = ([f"{kind}{i}" for i in range(200)] for kind in ("s", "c"))
    rows = [(0, " ".join(star))] + [(i, edited(r, star, f"x{i}")) for i in range(1, 400)]
    for i in range(300):
        rows.append((1000 + i, " ".join(link)))
        at = 7 * i % 192
        link[at : at + 8] = [f"n{i}w{k}" for k in range(8)]
    shared = [f"p{i}" for i in range(120)]
    rows += [(2000 + i, " ".join([*shared, *[f"q{i}w{k}" for k in range(60)]])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(docs).collect()}
    assert {found[i] for i in range(400)} == {0}
    assert {found[1000 + i] for i in range(300)} == {1000}
    assert all(found[2000 + i] == 2000 + i for i in range(400))


def test_near_dedup_uses_up_a_hot_bucket(spark):
    """Rounds do not end while copies of a large group are unmatched: 845 classes with rounds of 1, 2, 4, 8 and 16 sketches."""
    r = random.Random(17)
    words = [f"s{i}" for i in range(200)]
    rows = [(0, " ".join(words))] + [(i, edited(r, words, f"x{i}")) for i in range(1, 1501)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {x["class_id"] for x in near_dedup.classes(docs).collect()} == {0}


def test_secret_scan_finds_keys_behind_names(spark):
    """Names joined to a key do not hide it, and the best stretch is that of all stretches."""
    r = random.Random(23)
    letters = secret_scan.ALPHABET[:62]
    table = secret_scan.train(secret_scan.default_samples(spark))
    n, place = len(secret_scan.ALPHABET), {c: i for i, c in enumerate(secret_scan.ALPHABET)}
    leads = ("client_session=", "my_service_client_public=", "one/public/path/to/files/")
    rows = [(i, leads[i % 3] + "".join(r.choice(letters) for _ in range((20, 32, 40)[i // 3 % 3]))) for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: x["n_markov"] for x in secret_scan.scan(docs, table).collect()}
    assert sum(found.values()) > 0.95 * len(rows)
    for x in docs.limit(20).withColumn("best", secret_scan.best(F.col("text"), table)).collect():
        w = [table[place[a] * n + place[b]] - secret_scan.THRESHOLD for a, b in zip(x["text"], x["text"][1:], strict=False)]
        assert x["best"] == max(sum(w[i:j]) for i in range(len(w)) for j in range(i + secret_scan.LEAST_RUN - 1, len(w) + 1))


def test_repeated_lines_count_as_often_as_they_stand():
    """Texts of repeated lines with a few of their own in between are aligned, although their sets differ."""
    a, b = (np.array([v for k in range(60) for v in [1, 2, 3, 4, 5, *([base + k] if k % 6 == 0 else [])]]) for base in (100, 900))
    in_order, by_set = near_dedup.similarity(a, b)
    assert by_set < 0.4 and in_order == 300 / 320


def test_short_texts_and_small_tables_are_rejected_too():
    """A text that no model knows is rejected under 40 symbols, and where no documents are kept for the bound."""
    r = random.Random(29)
    words = "the of and to in is that for it was on are with as his they at be this from have or by one had not but what all were".split()
    strange = "привет как дела сегодня мой друг"
    for n in (100, 6):
        model = language_id.Identifier({"en": [" ".join(r.choice(words) for _ in range(80)) for _ in range(n)]})
        own = [" ".join(r.choice(words) for _ in range(k)) for k in (1, 2, 3, 5, 9, 40) for _ in range(20)]
        assert model.predict([strange, strange * 3], language_id.symbol_table())[3].all()
        assert not model.predict(own, language_id.symbol_table())[3].any()


def test_near_dedup_finds_the_links_of_brute_force(spark):
    """At least nine in ten of all pairs of texts whose shingle sets share 0.8 are in one class, on edited copies of many lengths."""
    r = random.Random(41)
    texts = []
    for g in range(60):
        words = [f"g{g}w{r.randrange(400)}" for _ in range(r.choice((60, 150, 400, 900)))]
        texts += [edited(r, words, f"g{g}c{c}", r.randrange(1, max(2, len(words) // 60))) for c in range(6)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(docs).collect()}
    assert len(pairs) > 300 and sum(found[i] == found[j] for i, j in pairs) >= 0.9 * len(pairs)
    # No class holds texts that no chain of links of the same rule joins.
    for i, c in found.items():
        assert i // 6 == c // 6


def test_a_hot_anchor_is_found_however_its_copies_are_dealt(spark):
    """A passage once in each of many partitions, each time with other words around it, is cut as brute force cuts it."""
    from tests.llm.test_edges import brute_repeats, prose

    passage = prose(77, 70)
    texts = [prose(3000 + i, 12) + passage + prose(5000 + i, 12) for i in range(640)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(64)
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.spans(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute_repeats([t.encode() for t in texts]))


def test_copies_of_a_text_are_worked_out_once(spark, monkeypatch):
    """Spans are found for different texts, not for each copy, which would give copies times copies; results are those of brute force."""
    from tests.llm.test_edges import brute_repeats, prose

    copied, short = prose(81, 260), prose(82, 20)
    texts = [copied] * 300 + [short] * 40 + ["", None] + [prose(6000 + i, 20) + copied[40 * i : 40 * i + 320] + prose(7000 + i, 20) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    counts = []

    def counted(*a, plain=suffix_dedup.repeated_spans):
        found = plain(*a)
        counts.append(found.count())
        return found

    monkeypatch.setattr(suffix_dedup, "repeated_spans", counted)
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.spans(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute_repeats([(t or "").encode() for t in texts]))
    kept = {x["doc_id"]: x["text"] for x in suffix_dedup.remove(docs).collect()}
    assert len(kept) == len(texts) and not kept[0] and kept[300] == short and kept[341] == ""
    assert max(counts) < 300


def test_segments_of_one_hash_are_compared_in_bytes():
    data = [b"one and other", b"one and three"]
    segment = np.array([7, 7, 7, 7], np.uint64)
    owner, first, last = np.array([0, 0, 1, 1]), np.array([0, 8, 0, 8]), np.array([3, 13, 3, 13])
    where, many, lead = suffix_dedup.equal(data, owner, first, last, segment)
    assert where[0] == where[2] and len(set(where.tolist())) == 3 and many.tolist() == [True, False, True, False] and lead.tolist() == [True, True, False, True]


def test_secret_scan_precision_and_recall(spark):
    """Planted keys that no base pattern names, against names, paths, hyphened words and ruled lines."""
    r = random.Random(31)
    letters = secret_scan.ALPHABET[:62]
    key = lambda n, a: "".join(r.choice(a) for _ in range(n))
    uuid = lambda: "-".join(key(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12))
    words = [w for w in secret_scan.WORDS if r.random() < 0.5]
    some = lambda: r.sample(words, r.randint(3, 6))
    secrets = [key(r.choice((20, 24, 32, 40, 64)), letters) if i % 4 else key(43, letters + "-_") if i % 8 else uuid() for i in range(400)]
    plain = ["_".join(some()) if i % 5 == 0 else "-".join(some()) if i % 5 == 1 else "/".join(some()) if i % 5 == 2 else "".join(w.title() for w in some()) if i % 5 == 3 else r.choice("-=_xA0") * r.randint(20, 90) for i in range(400)]
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(secrets + plain)], "doc_id long, text string")
    found = {x["doc_id"]: x["n_markov"] for x in secret_scan.scan(docs, secret_scan.train(secret_scan.default_samples(spark))).collect()}
    hits, wrong = sum(found[i] > 0 for i in range(400)), sum(found[i] > 0 for i in range(400, 800))
    assert hits >= 0.95 * 400 and wrong <= 0.02 * 400, (hits, wrong)


def test_trees_leave_out_most_products_of_clustered_vectors():
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 16)) * 64
    points = np.floor(centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16)) * 3).astype(np.int64)
    ids = np.arange(4000)
    trees = [topk_search.CoverTree(ids[i::2], points[i::2]) for i in (0, 1)]
    assert max(b - a for t in trees for (a, b), kids in zip(t.range, t.kids, strict=True) if not kids) <= topk_search.LEAF
    search = topk_search.Search(topk_search.CoverTree(ids[::20], points[::20]), 20)
    for t in trees:
        search.meet(t)
    assert search.products < 0.3 * 200 * 4000
    scores = points[::20] @ points.T
    got = list(zip(*(x.tolist() for x in search.hits()), strict=True))
    want = [(q, c, int(scores[i, c])) for i, q in enumerate(ids[::20].tolist()) for c in sorted((c for c in range(4000) if c != q), key=lambda c: (-scores[i, c], c))[:20]]
    assert sorted(got) == sorted(want)


def test_top_k_of_text_ids_over_many_cells(spark):
    r = random.Random(12)
    rows = [(f"v{i}", [r.gauss(0, 1) for _ in range(5)]) for i in range(600)]
    df = spark.createDataFrame(rows, "`vec.id` string, embedding array<double>")
    got = topk_search.top_k(df, lambda i: i.endswith("7"), k=5, block=40, query_block=6, id_column="vec.id").collect()
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    want = []
    for q in good:
        if q.endswith("7"):
            scored = sorted((-sum(x * y for x, y in zip(good[q], v, strict=True)), c) for c, v in good.items() if c != q)
            want += [(q, n, c, -s) for n, (s, c) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
