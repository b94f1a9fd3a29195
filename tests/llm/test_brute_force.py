"""Models and the whole pipeline against plain versions of themselves."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewell.llm import language_id, packing, quality, secret_scan, suffix_dedup

WORDS = public_tokenizers.path("word_bpe_49k.json")


def kneser_ney(texts: list[str], n: int, alphabet: int):
    """log p(symbol | context) by recursion over plain counters: raw counts at the top, numbers of different left symbols below."""
    padded = ["\0" * n + "".join(c if c.isalpha() else "\0" for c in t.lower()) for t in texts]
    top = Counter(t[i - n + 1 : i + 1] for t in padded for i in range(n, len(t)))
    counts = {n: top}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(gram: str) -> float:
        k = len(gram)
        if k == 0:
            return 1 / (alphabet + 1)
        own = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        once, twice = (sum(c == v for c in counts[k].values()) for v in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * p(gram[1:])

    return lambda t: -np.mean([math.log(p(t[i - n + 1 : i + 1])) for t in ["\0" * n + "".join(c if c.isalpha() else "\0" for c in t.lower())] for i in range(n, len(t))])


def test_entropies_equal_plain_kneser_ney():
    r = random.Random(5)
    texts = {lang: [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(30)) for _ in range(4)] for lang, letters in (("aa", "abcde"), ("bb", "cdefgh"))}
    models = language_id.Models(texts)
    alphabet = len({c if c.isalpha() else " " for t in texts.values() for x in t for c in x})
    plain = [kneser_ney(texts[lang], language_id.ORDER, alphabet) for lang in models.langs]
    asked = ["abc de, fgh", "xyz aa", "cdcd", "h" * 12]
    got, _, _ = models.entropies(asked, language_id.symbol_table())
    assert np.allclose(got, [[p(t) for p in plain] for t in asked], rtol=1e-4)


def test_quality_equals_plain_gaussians(spark):
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("etaoinsh") for _ in range(r.randint(1, 9))) for _ in range(r.randint(3, 90))) + r.choice(["", "!", " 12", "\nx"]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.length("text") % 3 == 0).cast("int").alias("quality"))
    rows = sorted(quality.classify(docs, labels).collect(), key=lambda x: x["doc_id"])
    x = quality.statistics(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    held = np.array([r["held_out"] for r in rows])
    y = np.array([len(t) % 3 == 0 for t in texts])
    own = [x[~held & (y == c)] for c in (False, True)]
    pooled = sum((o - o.mean(0)).T @ (o - o.mean(0)) for o in own) / (sum(map(len, own)) - 2)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    d = []
    for o in own:
        cov = ((1 - quality.TO_POOLED) * np.cov(o.T) + quality.TO_POOLED * pooled) / np.outer(scale, scale)
        cov = (1 - quality.TO_IDENTITY) * cov + quality.TO_IDENTITY * np.trace(cov) / len(cov) * np.eye(len(cov))
        z = (x - o.mean(0)) / scale
        d.append(-0.5 * (np.einsum("ij,ij->i", z, np.linalg.solve(cov, z.T).T) + np.linalg.slogdet(cov)[1]))
    score = 1 / (1 + np.exp(-((d[1] - d[0]) / quality.TEMPERATURE + np.log(len(own[1]) / len(own[0])))))
    assert np.allclose([r["score"] for r in rows], score, atol=1e-6)


def plain_near(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"\w+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {t}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, t) for i, t in docs if find(i) == i]


def plain_repeats(docs):
    n = suffix_dedup.LENGTH
    seen = Counter(t.encode()[k : k + n] for _, t in docs for k in range(len(t.encode()) - n + 1))
    out = []
    for i, t in docs:
        data = t.encode()
        covered = [False] * len(data)
        for k in range(len(data) - n + 1):
            if seen[data[k : k + n]] > 1:
                covered[k : k + n] = [True] * n
        out.append((i, bytes(b for b, c in zip(data, covered, strict=True) if not c).decode()))
    return out


def plain_secrets(docs, table):
    a, n = secret_scan.ALPHABET, len(secret_scan.ALPHABET)
    out = []
    for i, t in docs:
        spans = [m.span() for m in re.finditer(secret_scan.ASSIGN, t) if len(m.group(2)) >= 12] + [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18] + [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            w = [table[a.index(x) * n + a.index(y)] - secret_scan.THRESHOLD for x, y in zip(m.group(), m.group()[1:], strict=False)]
            best = max(sum(w[x:y]) for x in range(len(w)) for y in range(x + secret_scan.LEAST_RUN - 1, len(w) + 1))
            if best >= 0 and not any(x < m.end() and m.start() < y for x, y in spans):
                spans = [*spans, m.span()]
        merged = []
        for x, y in sorted(spans):
            if merged and x < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
            else:
                merged.append((x, y))
        at, parts = 0, []
        for x, y in merged:
            parts += [t[at:x], "[SECRET]"]
            at = y
        out.append((i, "".join(parts) + t[at:]))
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, base = prose(60), prose(150).split()
    texts = [prose(r.randint(5, 120)) for _ in range(60)] + [f"{prose(30)} {passage} {prose(30)}" for _ in range(8)]
    texts += [" ".join([*base[:k], "altered", *base[k + 1 :]]) for k in (20, 60, 100, 140)] + [texts[0], texts[1], None, "", "12 34", "привет как дела сегодня мой старый друг " * 3]
    texts += [f"{prose(12)} token = {'aB3' * 6} {prose(5)}", f"{prose(9)} {''.join(r.choice(secret_scan.ALPHABET[:62]) for _ in range(40))} {prose(9)}", f"{prose(4)} 0123456789abcdef0123 {prose(4)}"]
    docs = spark.createDataFrame([(i, t, "en" if t and t.isascii() else None, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table = secret_scan.train(secret_scan.default_samples(spark))
    kept = [(x["doc_id"], x["text"]) for x in language_id.accepted(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()]
    assert len(texts) - 12 < len(kept) < len(texts)
    want = plain_secrets(plain_repeats(plain_near(sorted(kept))), table)
    library = Tokenizer.from_file(WORDS)
    found = {}
    windows = Counter()
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found.setdefault(x["doc_id"], []).append(x)
        windows[x["sequence_id"]] += x["length"]
    assert set(found) == {i for i, _ in want}
    for i, t in want:
        ids = [*library.encode(t, add_special_tokens=False).ids, packing.END_ID]
        own = sorted(found[i], key=lambda x: x["start"])
        assert [x["doc_tokens"] for x in own] == [len(ids)] * len(own) and sum(x["length"] for x in own) == len(ids)
        assert [x["ids_crc32"] for x in own] == [zlib.crc32(np.array(ids[x["start"] : x["start"] + x["length"]], "<u4")) for x in own]
    assert sorted(windows) == list(range(len(windows))) and all(n == packing.SEQUENCE_TOKENS for k, n in windows.items() if k < len(windows) - 1)
