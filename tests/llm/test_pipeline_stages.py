"""Each stage of the pipeline against brute force, over odd rows: nulls, empty and very long texts, repeated ids and rows, and
columns named like those that the operators make."""

import hashlib
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C
from tidewater.llm import queries, toxicity

CLASHES = ["row", "id", "gone", "whole", "node", "line", "key", "copy", "p", "rate", "tokens", "domain", "ids", "component_id"]
STAGES = dict(C.STAGES)


@pytest.fixture(scope="module")
def rows():
    deal = np.random.default_rng(21)
    words = ["".join(deal.choice(list("abcdefghiklmnoprstuv"), int(deal.integers(3, 8)))) for _ in range(900)]
    said = lambda n: " ".join(deal.choice(words, n))
    out = []
    for i in range(150):
        lines = [said(20) for _ in range(3)]
        if i % 6 == 1:
            lines[1] += " rotten scoundrel rotten scoundrel"
        if i % 5 == 0:
            lines.append("A passage that many documents hold, word for word and letter for letter")
        if i % 5 == 2:
            lines.append("a passage that many documents hold, word for word and letter for letters ")
        out.append((i, "\n".join(lines)))
    first = out[3][1].split()
    close, far = [*first], [*first]
    close[30] = "other"
    for k in range(0, 60, 7):
        far[k] = f"far{k}"
    out += [(200, out[3][1]), (201, " ".join(close)), (202, " ".join(far)), (203, "short"), (204, "short"), (205, ""), (206, " \n\t\n"), (207, None), (None, None), (None, out[3][1])]
    return [*out, (208, said(40_000)), (209, "x" * 300_000), (210, "a\n" * 50_000)]


@pytest.fixture(scope="module")
def repeats(rows):
    """Ids that several rows have, with equal and with other texts."""
    return [*rows, rows[7], rows[7], (8, "another text of an id that is there already, with some more words in it")]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    labels = [(i, 1, int(i % 6 == 1)) for i in range(150)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def through(spark, name, rows, folder):
    docs = table(spark, rows)
    got = STAGES[name](spark, docs, folder)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    assert all(tuple(r[c] for c in CLASHES) == tuple(range(len(CLASHES))) for r in got.collect())
    return kept(got)


def test_toxicity_keeps_what_scores_under_the_threshold(spark, repeats, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    weights = toxicity.fit(table(spark, repeats), labels, toxicity.crc_rest("doc_id", 3) != 1)
    scorer = toxicity.Scorer(*weights)
    want = Counter((i, t) for i, t in repeats if scorer(t or "") < 0.7)
    assert through(spark, "toxicity", repeats, folder) == want
    bad = {i for i, t in repeats if t and "scoundrel" in t}
    assert not bad & {i for i, _ in want} and {i for i, _ in repeats} - bad == {i for i, _ in want}


def grams(line):
    return {line[k : k + 5] for k in range(len(line) - 4)}


def brute_lines(rows):
    """All pairs of lines by the Jaccard similarity of 5-grams; of each component the first line stays."""
    lines = []
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        lines += [(i, k, x.lower().strip(" \t\r\x0b\x0c")) for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    texts = list(dict.fromkeys(x[2] for x in lines))
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b]) if 0.8 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b])) else 0
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    place, seen, gone = {t: k for k, t in enumerate(texts)}, set(), defaultdict(set)
    for i, k, t in lines:
        if find(place[t]) in seen:
            gone[i].add(k)
        seen.add(find(place[t]))
    out = Counter()
    for i, t in rows:
        if i is not None and t is not None and i in gone:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
            if not t.strip():
                continue
        out[i, t] += 1
    return out


def test_line_dedup_equals_all_pairs(spark, rows, folder):
    assert through(spark, "line_dedup", rows, folder) == brute_lines(rows)


def test_line_dedup_of_repeated_ids_keeps_each_line_once(spark, repeats, folder):
    got = through(spark, "line_dedup", repeats, folder)
    assert got[None, None] == 1 and got[207, None] == 1
    found = Counter(x for (i, t), n in got.items() if i is not None and t for x in {line.lower().strip() for line in t.split("\n") if len(line) > 40} for _ in range(n))
    # rows that repeat an id and its text are one document, and come back as often as they came
    assert set(found.values()) <= {1, 3} and all(x in repeats[7][1].lower() for x, n in found.items() if n == 3)


def shingles(text, n=5):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = low.split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_ngram_join_keeps_one_of_each_component(spark, repeats, folder):
    known = [(i, shingles(t)) for i, t in repeats if i is not None]
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            (i, x), (j, y) = known[a], known[b]
            if x and y and 10 * len(x & y) >= 8 * len(x | y):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
    want = Counter((i, t) for i, t in repeats if i is None or find(i) == i)
    assert through(spark, "ngram_join", repeats, folder) == want
    assert {200, 201, 204} & {i for i, _ in want} == set() and {202, 205, 206, 207} <= {i for i, _ in want}


def test_mixing_thins_by_the_draw_of_an_id(spark, repeats, folder):
    got = through(spark, "mixing", repeats, folder)
    every = Counter(repeats)
    assert all(n == every[x] for x, n in got.items()) and all(got[x] == n for x, n in every.items() if x[0] is None)
    # repeated ids share one fate, and nothing else than labelled kinds of text is thinned
    assert {x for x in every if x[0] == 7} <= set(got) or not {x for x in every if x[0] == 7} & set(got)
    gone = {i for i, _ in every} - {i for i, _ in got}
    assert all("scoundrel" in dict(repeats)[i] for i in gone)


def test_encoding_equals_the_library(spark, repeats, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    want = Counter()
    for i, t in repeats:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    got = STAGES["sentencepiece"](spark, table(spark, repeats), folder)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
