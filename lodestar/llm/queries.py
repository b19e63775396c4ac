"""The queries of this package, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from lodestar.llm.common import fold, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_binary_output(spark, sf_dir):
    from lodestar.llm.rans import encode_corpus, read_blocks

    return read_blocks(spark, encode_corpus(table(sf_dir, "documents", spark), _vocabulary("byte_bpe_50k.json"), end_id=2))


def op2_html_extraction(spark, sf_dir):
    from lodestar.llm.html_text import main_text

    return main_text(table(sf_dir, "pages", spark))


def op3_toxicity(spark, sf_dir):
    from lodestar.llm.toxicity import detect

    out = detect(table(sf_dir, "documents", spark), table(sf_dir, "labels", spark), folds=4, held_out=2, threshold=0.3)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op4_ngram_jaccard_join(spark, sf_dir):
    from lodestar.llm.partenum import similarity_components

    return similarity_components(table(sf_dir, "documents", spark), k=3, percent=90)


def op5_token_counts(spark, sf_dir):
    from lodestar.llm.token_counts import count_tokens

    return count_tokens(table(sf_dir, "documents", spark), _vocabulary("piece_bpe_32k.model"))


def op6_quality_rules(spark, sf_dir):
    from lodestar.llm.quality import score

    out = score(table(sf_dir, "documents", spark))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op7_language_id(spark, sf_dir):
    from lodestar.llm.langid import identify

    out = identify(table(sf_dir, "documents", spark), folds=4, held_out=2)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark, sf_dir):
    from lodestar.llm.lm import score_corpus

    return score_corpus(table(sf_dir, "documents", spark), folds=5, held_out=1)


def op9_decontamination(spark, sf_dir):
    from lodestar.llm.winnowing import contamination, digest

    docs, bench = table(sf_dir, "documents", spark), table(sf_dir, "benchmark", spark)
    return digest(contamination(docs.select("doc_id", "text"), bench))


def op10_packing(spark, sf_dir):
    from lodestar.llm.packing import pack

    return pack(table(sf_dir, "documents", spark), _vocabulary("byte_bpe_50k.json"), end_id=1, seq_len=2048)


def op11_importance_resampling(spark, sf_dir):
    from lodestar.llm.resampling import resample

    return resample(table(sf_dir, "documents", spark), table(sf_dir, "benchmark", spark), percent=5, min_words=20, seed=42)


def op12_exact_dedup(spark, sf_dir):
    from lodestar.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(sf_dir, "documents", spark))


def op13_lexical_search(spark, sf_dir):
    from lodestar.llm.lexical import build, search

    return search(build(table(sf_dir, "documents", spark)), table(sf_dir, "benchmark", spark), k=50)


QUERIES = {"op1_binary_output": op1_binary_output, "op2_html_extraction": op2_html_extraction, "op3_toxicity": op3_toxicity, "op4_ngram_jaccard_join": op4_ngram_jaccard_join, "op5_token_counts": op5_token_counts, "op6_quality_rules": op6_quality_rules, "op7_language_id": op7_language_id, "op8_lm_scoring": op8_lm_scoring, "op9_decontamination": op9_decontamination, "op10_packing": op10_packing, "op11_importance_resampling": op11_importance_resampling, "op12_exact_dedup": op12_exact_dedup, "op13_lexical_search": op13_lexical_search}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(r"[^\x20\x09-\x0D]+")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
      FROM (SELECT doc_id, w, least(3, len(w)) AS n, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n_shingles FROM g GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.n = y.n AND x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
          JOIN z u ON u.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * common >= 90 * (u.n_shingles + v.n_shingles - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(z.n_shingles, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a) m USING (doc_id)
"""
_OP9 = f"""
WITH d AS (SELECT doc_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
b AS (SELECT item_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
_OP11 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
b AS (SELECT {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, range(1, 4) t(k) WHERE len(w) >= k)),
g AS MATERIALIZED (SELECT array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b, range(1, 4) t(k) WHERE len(w) >= k)),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
u AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION SELECT x FROM g)),
crc AS MATERIALIZED (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) AS bigint))), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM u, tab),
s AS (SELECT bucket, count(*) AS n FROM f JOIN crc USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM g JOIN crc USING (x) GROUP BY bucket),
gain AS (SELECT bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((SELECT count(*) FROM f) + 10000)::double / ((s.n + 1)::double * ((SELECT count(*) FROM g) + 10000)::double))) AS bigint) AS gain FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT doc_id, count(*) AS n_features, cast(sum(gain) AS bigint) AS weight FROM f JOIN crc USING (x) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || doc_id), 1, 8) AS bigint) + 0.5::double) / 4294967296::double))) AS bigint) AS score FROM d LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
_OP12 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS x FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER w = 1 AS kept, sha256(x) AS text_sha256
FROM d WINDOW w AS (PARTITION BY x ORDER BY n DESC, doc_id)
"""
_OP13 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")} AS w FROM documents),
z AS (SELECT count(*) AS n, sum(len(w))::bigint AS l FROM d WHERE len(w) > 0),
p AS MATERIALIZED (SELECT doc_id, x, len(w) AS n, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS x FROM d) GROUP BY ALL),
v AS (SELECT x, cast(floor(1000 * ln((2 * z.n + 2)::double / (2 * count(*) + 1)::double)) AS bigint) AS w FROM p, z GROUP BY x, z.n),
i AS (SELECT DISTINCT item_id, unnest({_words(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")}) AS x FROM benchmark),
s AS (SELECT item_id, doc_id, cast(sum(v.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * z.n) // z.l)))) AS bigint) AS score FROM i JOIN v USING (x) JOIN p USING (x), z GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
#: The other operators learn models or call tokenizers, which SQL can't; tests/llm compares them with brute force.
ORACLES: dict[str, str] = {"op4_ngram_jaccard_join": _OP4, "op9_decontamination": _OP9, "op11_importance_resampling": _OP11, "op12_exact_dedup": _OP12, "op13_lexical_search": _OP13}
