"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from acctrisk.llm import exact, jaccard, lines, mixing, neighbours, packing, phrases, pieces, quality, search, shards, tokens, warc
from acctrisk.llm.common import shared_folder, table

#: Target weights: shares of the mix in parts; sources not named have one part.
MIX_WEIGHTS = {"src0": 6, "src1": 3, "src2": 2}


def op1_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"), shared_folder(spark, "archive"))


def op2_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_WEIGHTS)


def op3_line_dedup(spark, sf_dir):
    docs = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_token_counts(spark, sf_dir):
    return tokens.token_counts(spark, f"{sf_dir}/documents.parquet")


def op5_jaccard_join(spark, sf_dir):
    return jaccard.similar_texts(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_vectors(spark, sf_dir):
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return shards.assign_shards(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact.mark_duplicates(table(spark, sf_dir, "documents"))


def op11_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_pieces(spark, sf_dir):
    docs = pieces.encode_texts(table(spark, sf_dir, "documents"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_mixing, op3_line_dedup, op4_token_counts, op5_jaccard_join, op6_quality, op7_near_vectors, op8_packing,
    op9_sharding, op10_exact_dedup, op11_search, op12_phrases, op13_pieces)}

SQL = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op3_line_dedup": r"""
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
        l AS (SELECT doc_id, unnest(own) AS line, generate_subscripts(own, 1) AS pos FROM s),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40
              GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT k.doc_id, k.pos, k.line, c.holder IS NOT NULL AND c.holder <> k.doc_id AS gone
              FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM t""",
    "op11_search": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (SELECT CAST(count(*) FILTER (WHERE len(terms) > 0) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
        p AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
        f AS (SELECT row, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
              FROM f, s GROUP BY term, docs),
        i AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * docs) // total)))) AS impact
              FROM f JOIN w USING (term), s),
        r AS (SELECT item_id, doc_id, row, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10""",
    "op12_phrases": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                   FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
        s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0),
        t AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY lang),
        g AS (SELECT lang, words[i:i + m - 1] AS g, m FROM s, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(words)),
        f AS (SELECT lang, g, m, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
        dropped AS (SELECT DISTINCT a.lang, a.g FROM (
                SELECT lang, g[1:m - 1] AS g, f FROM f WHERE m > 2 UNION ALL SELECT lang, g[2:m] AS g, f FROM f WHERE m > 2) b
            JOIN f a ON a.lang = b.lang AND a.g = b.g AND a.f = b.f),
        c AS (SELECT * FROM f WHERE m >= 2 AND NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = f.lang AND d.g = f.g)),
        k AS (SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, n,
                     CAST((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
              FROM c JOIN (SELECT unnest(range(1, 5)) AS k) ON k < c.m JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k]
              JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:c.m] JOIN t ON t.lang = c.lang),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS cut FROM k),
        o AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM b WHERE cut = 1),
        z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o)
        SELECT * FROM z WHERE rank <= 2000""",
}
