"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
# Target shares of tokens; the reference domain keeps its tokens and the others are thinned to fit.
MIX_WEIGHTS = {"clean": 0.92, "low": 0.06, "toxic": 0.02}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dups import removed_by_document

    return removed_by_document(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    found = scan(_table(spark, sf_dir, "documents"))
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("places"), F.min("first_word").alias("first_word"), F.max("containment").alias("containment"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dups import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), model_path()).withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import domain_of, mix

    labels = _table(spark, sf_dir, "labels").select("doc_id", domain_of().alias("domain"))
    return mix(_table(spark, sf_dir, "documents"), labels, MIX_WEIGHTS, reference="clean")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attention_lm import lm_scores
    from .toxicity import crc_rest

    scored = lm_scores(_table(spark, sf_dir, "documents"), model_path(), learn=crc_rest("doc_id", 5) != 1)
    return scored.withColumn("held_out", crc_rest("doc_id", 5) == 1)


def op10_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm_codec import digests, encode_decode

    return digests(encode_decode(_table(spark, sf_dir, "documents"), model_path()))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    from .packing import pack

    got = pack(_table(spark, sf_dir, "documents"), (tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN), size=1024)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"), every=100, heads=6)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import manifest
    from .toxicity import crc_rest

    return manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered=crc_rest("doc_id", 3) == 0).drop("lang")


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_toxicity, op3_ngram_jaccard_join, op4_line_dedup, op5_license_scan, op6_embedding_near_dedup, op7_token_counts, op8_mixing, op9_lm_scoring, op10_sentencepiece_codec, op11_packing, op12_prefix_trie, op13_merkle_manifest)}
_REACH = """
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT a AS x, b AS y FROM edges UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a),
        least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)"""


def _crc(text: str) -> str:
    """crc32 of ASCII text, bit by bit."""
    return f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), CAST(4294967295 AS BIGINT)))"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op3_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
              ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id
                  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),{_REACH}
        SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id FROM s LEFT JOIN least ON x = doc_id
    """,
    "op6_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda t: CAST(t AS DOUBLE)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda t: t IS NULL OR NOT isfinite(t))) = 0 AND len(list_filter(embedding, lambda t: t <> 0)) > 0),
        links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id
                  WHERE list_inner_product(p.v, q.v) / (sqrt(list_inner_product(p.v, p.v)) * sqrt(list_inner_product(q.v, q.v))) >= 0.9),{_REACH},
        n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, least(vec_id, coalesce(y, vec_id)) = vec_id AS kept
        FROM embeddings LEFT JOIN least ON x = vec_id LEFT JOIN n ON a = vec_id
    """,
    "op13_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf('text')} AS leaf, CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf(_LOWER)} END AS other FROM documents),
        p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
        t AS (SELECT 0 AS lev, grp, n, pos AS node, leaf AS hash FROM p
              UNION ALL SELECT lev + 1, grp, (n + 7) // 8, node // 8, sha256(string_agg(hash, '' ORDER BY node)) FROM t WHERE n > 1 GROUP BY lev, grp, n, node // 8),
        s AS (SELECT grp, hash AS subroot, lev AS height, row_number() OVER (ORDER BY grp) - 1 AS k, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (SELECT 0 AS lev, n, k AS node, subroot AS hash FROM s
              UNION ALL SELECT lev + 1, (n + 7) // 8, node // 8, sha256(string_agg(hash, '' ORDER BY node)) FROM u WHERE n > 1 GROUP BY lev, n, node // 8),
        w AS (SELECT grp, lev, CAST(NULL AS BIGINT) AS high, node, n, hash FROM t UNION ALL SELECT s.grp, height + u.lev, u.lev, node, u.n, hash FROM s, u WHERE u.n > 1),
        f AS (SELECT doc_id, pos AS id, p.grp, 0 AS lev, pos AS node, leaf, other, coalesce(other, leaf) AS h, '' AS sib FROM p
              UNION ALL
              SELECT f.doc_id, f.id, f.grp, f.lev + 1, any_value(f.at) // 8, f.leaf, f.other, sha256(string_agg(CASE WHEN w.node = f.at THEN f.h ELSE w.hash END, '' ORDER BY w.node)), f.sib || coalesce(string_agg(w.hash, '' ORDER BY w.node) FILTER (w.node <> f.at), '')
              FROM (SELECT f.*, CASE WHEN f.lev = height THEN k ELSE f.node END AS at, f.lev >= height AS up FROM f JOIN s ON s.grp = f.grp) f
              JOIN w ON w.grp = f.grp AND w.lev = f.lev AND w.n > 1 AND w.node // 8 = f.at // 8 AND (w.high IS NOT NULL) = f.up GROUP BY f.doc_id, f.id, f.grp, f.lev, f.leaf, f.other, f.h, f.sib)
        SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM f JOIN s ON s.grp = f.grp, (SELECT hash AS root, lev AS top FROM u WHERE n = 1) WHERE f.lev = height + top
    """,
    "op12_prefix_trie": f"""
        WITH own AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, ''))) AS said FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        lead AS (SELECT c, said, {_crc('CAST(c AS VARCHAR)')} % 6 AS h FROM own),
        built AS (SELECT l.c, list_concat(coalesce(b.said[1:h], []), l.said[h + 1:]) AS s FROM lead l LEFT JOIN own b ON b.c = l.c - l.c % 100),
        steps AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth, s FROM built),
        node AS (SELECT depth, s[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs, coalesce(list(c ORDER BY c) FILTER (n = depth), []) AS ends FROM steps GROUP BY 1, 2),
        named AS (SELECT n.*, p.conv_id AS parent_conv_id, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.path[n.depth].t) ELSE 0 END AS saved FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = n.path[1:p.depth]),
        kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM named WHERE depth > 0 GROUP BY 1, 2),
        below AS (SELECT a.conv_id, a.depth, sum(b.saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
                  FROM named a JOIN named b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path LEFT JOIN kids k ON k.conv_id = b.conv_id AND k.depth = b.depth GROUP BY 1, 2)
        SELECT n.conv_id, n.depth, parent_conv_id, n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(array_to_string(ends, ',')) AS ends_sha256
        FROM named n JOIN below b ON b.conv_id = n.conv_id AND b.depth = n.depth LEFT JOIN kids k ON k.conv_id = n.conv_id AND k.depth = n.depth
    """,
}
