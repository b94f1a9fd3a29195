"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import bpe_automaton, language_id, media_chunks, near_dedup, packing, quality, secret_scan, suffix_dedup, token_files, tokenise, topk_search

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, letters: str = "etaoinshrdlu") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every odd case, and columns whose names operators use inside."""
    r = random.Random(5)
    shared = prose(1, 90)
    texts = [None, "", " \n ", "x", "é" * 300, prose(2, 60), prose(2, 60), prose(2, 60) + " one more", shared + prose(3, 40), prose(4, 30) + shared, 'token = "abcdefABCDEF123456"', "AKIA" + "Q" * 16 + " and 0123456789abcdef01", "<|endoftext|>日本語 ½ İ", "a" * 3000, prose(6, 20_000), "key " + "".join(r.choice("ABCXYZabcxyz0189+/") for _ in range(40))]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id here at all, none", "en", None, 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, ROWS)
    for name in ("row", "tid", "found", "packed", "spans", "kind", "start", "id", "key", "new"):
        docs = docs.withColumn(name, F.lit(name))
    return docs.repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ROWS)


def stored(spark, df, tmp_path):
    df.write.parquet(path := f"file://{tmp_path}/docs")
    return spark.read.parquet(path)


def by_text(docs, out):
    """Result rows beside texts, paired by id and order; ids that repeat have equal texts here."""
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in out.collect():
        if r["doc_id"] is not None:
            yield texts[r["doc_id"]][0], r


def test_secret_scan(spark, odd, none, tmp_path):
    table = secret_scan.train(secret_scan.default_samples(spark))
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = secret_scan.scan(odd, table)
    assert out.count() == odd.count()
    for text, r in by_text(odd, out):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        listed = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("markov")] == listed
    assert max(r["n_markov"] for _, r in by_text(odd, out)) == 1
    assert secret_scan.scan(none, table).count() == 0
    docs = stored(spark, odd, tmp_path)
    clean = secret_scan.redact(docs, table)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert {r["text"] for r in clean.where("doc_id = 10").collect()} == {'[SECRET]"'}
    assert clean.where("text IS NULL").count() == 2


def test_markov_ratio_is_the_sum_of_its_transitions(spark):
    table = secret_scan.train(secret_scan.default_samples(spark, 300))
    n, place = len(secret_scan.ALPHABET), {c: i for i, c in enumerate(secret_scan.ALPHABET)}
    for s in ("abcABC019", "a", "zz"):
        want = sum(table[place[a] * n + place[b]] for a, b in zip(s, s[1:], strict=False))
        assert spark.range(1).select(secret_scan.ratio(F.lit(s), table).alias("r")).first()["r"] == want


def brute_repeats(texts, length=suffix_dedup.LENGTH):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
        yield len(t), int(covered.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~covered])).hexdigest()


def test_suffix_dedup_equals_brute_force(spark, none):
    passage = prose(8, 150)
    r = random.Random(2)
    texts = [None, "", "a" * 900, "ab" * 400, "x" * 199, prose(9, 300) * 2, prose(9, 300)]
    texts += [prose(100 + i, r.randint(0, 60)) + passage[: r.choice([600, 350])] + prose(900 + i, r.randint(0, 60)) for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.spans(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute_repeats([(t or "").encode() for t in texts]))
    assert suffix_dedup.spans(none).count() == 0


def test_suffix_dedup_keeps_characters_whole(spark, odd):
    kept = suffix_dedup.remove(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    data = "aéb".encode()
    assert suffix_dedup.cut_text(data, [(0, 2)]) == "éb" and suffix_dedup.cut_text(data, [(2, 4)]) == "aé"


def test_refinement_equals_sorting():
    r = random.Random(4)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 60))) for _ in range(40)]
    shards = [suffix_dedup.Transform(strings[i : i + 10]) for i in range(0, 40, 10)]
    for shard, own in zip(shards, (strings[i : i + 10] for i in range(0, 40, 10)), strict=True):
        suffixes = [own[s][p:] + b"\0" for s, p in zip(shard.string, shard.place, strict=True)]
        assert suffixes == sorted(suffixes)
    places = suffix_dedup.refine(shards, 5)
    rows = [(int(p), (strings[10 * k + s][q:] + b"\0" * 5)[:5]) for k, (shard, place) in enumerate(zip(shards, places, strict=True)) for p, s, q in zip(place, shard.string, shard.place, strict=True)]
    assert [b for _, b in sorted(rows)] == sorted(b for _, b in rows)
    assert len({p for p, _ in rows}) == len(set(rows))


def test_quality_learns_and_holds_out(spark, odd, none):
    docs = spark.createDataFrame([(i, prose(i, 80) + "." if i % 2 else " | ".join(prose(i, 30).upper().split())) for i in range(400)] + [(400, None), (401, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(7, None), (None, 1)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) / len(held) > 0.95
    assert {r["score"] for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def brute_top(vectors, k, every):
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in good if c != q)
            yield from ((q, rank, c, -s) for rank, (s, c) in enumerate(scored[:k], 1))


def test_top_k_equals_brute_force(spark):
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    vectors = [(i, [c + r.gauss(0, 0.1) for c in r.choice(centres)]) for i in range(700)]
    vectors += [(700, None), (701, [None] * 6), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (704, []), (None, [1.0] * 6), (720, [0.5] * 6), (721, [0.5] * 6), (722, [0.5] * 3)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("tree", F.lit(1)).withColumn("b", F.lit(1))
    got = sorted(map(tuple, topk_search.top_k(df, lambda i: i % 20 == 0, block=150, query_block=16).collect()))
    assert got == sorted(brute_top(vectors, 20, 20))
    few = topk_search.top_k(df.where("vec_id IN (720, 721, 722)"), lambda i: i % 20 == 0).orderBy("rank").collect()
    assert [x["vec_id"] for x in few] == [721, 722]
    assert topk_search.top_k(df.where("false"), lambda i: i % 20 == 0).count() == 0


def test_packing(spark, odd, none):
    library = Tokenizer.from_file(WORDS)
    pieces = packing.pack(odd, WORDS, length=64).collect()
    windows, docs = {}, {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        docs.setdefault(p["doc_id"], []).append(p)
    for k, w in windows.items():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == 64 or k == max(windows)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for doc, own in docs.items():
        if doc not in (None, 5):
            ids = [*library.encode(texts[doc], add_special_tokens=False).ids, packing.END_ID]
            assert [p["start"] for p in sorted(own, key=lambda p: p["start"])][0] == 0 and sum(p["length"] for p in own) == len(ids)
            for p in own:
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")) and p["doc_tokens"] == len(ids)
    assert packing.pack(none, WORDS).count() == 0


def test_near_dedup(spark, none, tmp_path):
    base = prose(11, 300).split()
    rows = [(i, " ".join([*base[:k], f"changed{i}", *base[k + 1 :]])) for i, k in enumerate(range(10, 290, 14))]
    moved = " ".join([*base[150:], *base[:150]])
    rows += [(100, " ".join(base)), (101, moved), (102, prose(12, 300)), (103, None), (104, ""), (105, "two words"), (106, "two words"), (107, "Two, words!"), (None, prose(13, 50)), (102, prose(12, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tid", F.lit(1)).withColumn("root", F.lit(2))
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert {found[i] for i in range(20)} == {0} and found[100] == found[101] == 0
    assert found[102] == 102 and found[103] == found[104] == 103 and found[105] == found[106] == found[107] == 105 and found[None] is None
    kept = near_dedup.keep_one(stored(spark, docs, tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [-1, 0, 102, 103, 105]
    assert near_dedup.classes(none).count() == 0


def test_alignment_is_the_longest_common_subsequence():
    r = random.Random(9)
    for _ in range(60):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(1, 25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert near_dedup.aligned(np.array(a), np.array(b), 30) == best[-1][-1]


def test_token_files(spark, odd, none):
    library = Tokenizer.from_file(BYTES)
    rows = sorted(token_files.round_trip(odd, BYTES, shard_ids=500).collect(), key=lambda r: r["start"])
    docs = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at = 0
    for r, (doc, text) in zip(rows, docs, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, token_files.END_ID], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert token_files.round_trip(none, BYTES).count() == 0


def test_elias_fano():
    r = random.Random(1)
    for n, most in ((1, 5), (700, 10**6), (2000, 300), (1500, 10**12)):
        values = np.array(sorted(r.randint(0, most) for _ in range(n)))
        coded = token_files.EliasFano.frombytes(token_files.EliasFano.of(values).tobytes())
        assert (coded.all() == values).all() and [coded.select(i) for i in range(0, n, 37)] == values[::37].tolist()
    shard = token_files.Shard(token_files.shard_bytes([None, -5, -5, 9], [b"\1\0", b"", b"\2\0\3\0", b"\4\0"], 2))
    assert shard.doc_ids() == [None, -5, -5, 9] and [shard.document(i).tolist() for i in range(4)] == [[1], [], [2, 3], [4]]


def test_media_chunks(spark, odd, none):
    big = prose(21, 30_000)
    docs = odd.select("doc_id", "text", "row", "kind").unionAll(spark.createDataFrame([(50, big, "", ""), (51, "!" + big, "", "")], "doc_id long, text string, row string, kind string"))
    values = {}
    for text, r in by_text(docs, media_chunks.round_trip(docs)):
        data = text.encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert values.setdefault(text, tuple(r)[1:]) == tuple(r)[1:]
    assert media_chunks.round_trip(none).count() == 0


def test_chunks_are_cut_by_content(spark):
    table = media_chunks.gear_table()
    data = np.frombuffer(random.Random(1).randbytes(400_000), np.uint8)
    ends = []
    for lead in (0, 777):
        own = np.concatenate([np.full(lead, 7, np.uint8), data])
        allowed = np.flatnonzero((media_chunks.gear(own, table) & np.uint32((1 << media_chunks.CUT_BITS) - 1)) == 0) + 1
        ends.append({e - lead for e in media_chunks.cuts(allowed, len(own))})
    assert len(ends[0] & ends[1]) > 0.8 * len(ends[0])


def test_language_id(spark, odd, none):
    alphabets = {"aa": "etaoin", "bb": "zqxjkv", "cc": "абвгде"}
    docs = spark.createDataFrame([(i, prose(i, 60, alphabets[lang]), lang) for i, lang in enumerate(list(alphabets) * 60)] + [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None)], "doc_id long, text string, lang string").withColumn("held_out", F.lit(3))
    rows = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(rows[i]["lang_pred"] == lang and not rows[i]["rejected"] for i, lang in enumerate(list(alphabets) * 60))
    assert [rows[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == 180
    assert language_id.identify(odd).count() == odd.count()
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(none).count() == 0


def test_kneser_ney_probabilities_sum_to_one():
    text = prose(31, 400, "abcd")
    models = language_id.Models({"x": [text]})
    table = language_id.symbol_table()
    for context in ("abc", "d a", "   ", "dda"):
        following = [f"{context}{c}" for c in "abcd "]
        total = sum(float(np.exp(models.logs(language_id.symbols([t], table)[0][len(language_id._GAP) : len(language_id._GAP) + 4])[0, 0])) for t in following)
        assert 0.9 < total < 1.001


def test_bpe_automaton(spark, odd, none):
    library = Tokenizer.from_file(WORDS)
    for text, r in by_text(odd, bpe_automaton.digests(odd, WORDS)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_automaton.digests(none, WORDS).count() == 0


def test_tokenisers_on_random_texts():
    r = random.Random(7)
    own, words, pieces = bpe_automaton.encoder(WORDS), tokenise.encoder(WORDS), tokenise.encoder(BYTES)
    by_word, by_byte = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    letters = ["aaaabbcdeé'stvreml THEßŉſÀ  \n\t\r.,!?0123½<|>日本İ́\x1c\x85\xa0\xad ΣσA", "aab", "etaoinshr ", "'s're "]
    for _ in range(3000):
        text = "".join(r.choice(letters[r.randrange(4)]) for _ in range(r.randint(0, 40)))
        a, b = by_word.encode(text, add_special_tokens=False).ids, by_byte.encode(text, add_special_tokens=False).ids
        ids, decoded = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == a and decoded.decode() == by_word.decode(a, skip_special_tokens=False)
        assert np.frombuffer(words.encode(text), "<u4").tolist() == a and np.frombuffer(pieces.encode(text), "<u4").tolist() == b
