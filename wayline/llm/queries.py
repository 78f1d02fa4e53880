"""The registered queries opN_<name>: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; drivers and executors have the same one."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_digests

    return archive_digests(table(spark, sf_dir, "pages"))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import MEDIA, STORED, media_digests, store_features, store_media
    from .scratch import new_path

    media, features = new_path(spark, "media"), new_path(spark, "features")
    store_media(table(spark, sf_dir, "documents"), media)
    store_features(spark.read.schema(MEDIA).parquet(media), features)
    return media_digests(spark.read.schema(STORED).parquet(features))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document's is its source, its language, its id's thousands and its id."""
    from .licenses import scan

    docs = table(spark, sf_dir, "documents")
    thousands = F.floor(F.col("doc_id") / 1000).cast("string")
    return scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", thousands, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify
    from .textvec import crc_bucket

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs, F.pmod(crc_bucket(F.col("doc_id")), F.lit(4)) != 2)
    return found.withColumn("held_out", F.pmod(crc_bucket(F.col("doc_id")), F.lit(4)) == 2)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import new_path
    from .token_files import token_digests, write_token_files

    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2, words_only=True)
    return token_digests(spark, path)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify
    from .textvec import crc_bucket

    docs, held = table(spark, sf_dir, "documents"), F.pmod(crc_bucket(F.col("doc_id")), F.lit(5)) == 0
    return classify(docs, docs, table(spark, sf_dir, "labels"), ~held, threshold=0.3).withColumn("held_out", held)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, per_hundred=85)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attention_lm import score
    from .textvec import crc_bucket

    return score(table(spark, sf_dir, "documents"), F.pmod(crc_bucket(F.col("doc_id")), F.lit(5)) == 1, tokenizer_file("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_nodes

    return prefix_nodes(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def queries():
    dealt = (op1_warc, op2_audio, op3_licenses, op4_language_id, op5_token_files, op6_quality, op7_minhash_near_dedup, op8_best_fit_packing, op9_attention_lm, op10_decontamination)
    return {f.__name__: f for f in (*dealt, op11_prefix_trie, op12_ranked_search, op13_secret_scan)}


ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT *, octet_length(encode(html)) AS size, min(page_id) OVER (PARTITION BY html) AS first_id, row_number() OVER (PARTITION BY html ORDER BY page_id) AS k FROM p)
        SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
          CASE WHEN size >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN size >= 100 AND k > 1 THEN first_id END AS refers_to
        FROM f
    """,
    "op3_licenses": r"""
        WITH f AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id // 1000 AS VARCHAR), doc_id || '.txt') AS path, concat_ws('/', source, lang, CAST(doc_id // 1000 AS VARCHAR)) AS dir, coalesce(text, '') AS text FROM documents),
        x AS (SELECT doc_id, path, dir, length(text) AS size, unnest(list_filter(string_split_regex(text, '\r?\n'), lambda s: regexp_matches(s, '(?i)licen[sc]|copyright|spdx|rights reserved|public domain'))) AS unit FROM f),
        t(license, unit) AS (VALUES {templates}),
        both_ AS (SELECT DISTINCT unit, CAST(NULL AS VARCHAR) AS license FROM x UNION ALL SELECT unit, license FROM t),
        c AS (SELECT unit, license, term, count(*) AS tf FROM (SELECT unit, license, unnest(regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+(?:[.][0-9]+)*')) AS term FROM both_) GROUP BY ALL),
        idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM both_)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
        w AS (SELECT unit, license, c.term, tf * idf AS w FROM c JOIN idf ON c.term = idf.term),
        n AS (SELECT unit, license, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
        s AS (SELECT a.unit, b.license, round(sum(a.w * b.w) / (any_value(na.norm) * any_value(nb.norm)), 6) AS similarity FROM w a JOIN w b ON a.term = b.term AND a.license IS NULL AND b.license IS NOT NULL
          JOIN n na ON na.unit = a.unit AND na.license IS NULL JOIN n nb ON nb.license = b.license GROUP BY a.unit, b.license),
        m AS (SELECT unit, license, similarity FROM s WHERE similarity >= 0.7 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY similarity DESC, license) = 1),
        h AS (SELECT doc_id, path, dir, size, x.unit, license, similarity FROM x JOIN m ON x.unit = m.unit),
        own AS (SELECT doc_id, dir, license, similarity, sum(length(unit)) OVER (PARTITION BY doc_id) >= 0.5 * size AS speaks FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, license) = 1),
        spoken AS (SELECT dir AS ancestor, license AS dir_license FROM own WHERE speaks QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license) = 1),
        near AS (SELECT d.dir, ancestor, dir_license FROM (SELECT DISTINCT dir FROM f) d JOIN spoken ON d.dir = ancestor OR starts_with(d.dir, ancestor || '/') QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(ancestor) DESC) = 1)
        SELECT f.doc_id, f.path, own.license, own.similarity, coalesce(own.license, dir_license) AS effective_license, CASE WHEN own.license IS NULL THEN ancestor END AS inherited_from
        FROM f LEFT JOIN own ON f.doc_id = own.doc_id LEFT JOIN near ON f.dir = near.dir
    """,
    "op10_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, len(w[i:i+9]) AS n, array_to_string(w[i:i+9], ' ') AS k
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        pos AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS k
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        places AS (SELECT item_id, i AS o, len(w[i:i+9]) AS n, array_to_string(w[i:i+9], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        runs AS (SELECT doc_id, item_id, o, i, pos.n, i - row_number() OVER (PARTITION BY doc_id, item_id, i - o ORDER BY i) AS run FROM pos JOIN places ON pos.k = places.k AND pos.n = places.n),
        matches AS (SELECT doc_id, item_id, min(o) - 1 AS item_offset, min(i) - 1 AS doc_offset, count(*) - 1 + any_value(n) AS words FROM runs GROUP BY doc_id, item_id, i - o, run),
        longest AS (SELECT doc_id, words AS longest_words, item_id AS longest_item, item_offset, doc_offset FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, item_id, item_offset, doc_offset) = 1),
        hit AS (SELECT DISTINCT doc_id, pos.n, i, item_id FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n),
        marked AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hit) GROUP BY doc_id),
        found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
        SELECT d.doc_id, coalesce(CAST(len(d.w) AS BIGINT), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_words, 0) AS longest_words, longest_item, item_offset, doc_offset
        FROM d LEFT JOIN longest ON longest.doc_id = d.doc_id LEFT JOIN marked ON d.doc_id = marked.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
    """,
    "op12_ranked_search": r"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
        n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
        s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM f, s),
        m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // words) AS m FROM n, s),
        r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
          FROM q JOIN w ON q.term = w.term JOIN p ON p.term = q.term JOIN m USING (doc_id) GROUP BY item_id, doc_id HAVING sum(w) > 0)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
    """,
    "op11_prefix_trie": r"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(crc, 4294967295) % 9 AS h FROM (SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM (SELECT DISTINCT conv_id FROM t))),
        r AS (SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN t ON t.conv_id = c.base AND place <= h UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place > h),
        l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, place) AS turns FROM r GROUP BY conv_id),
        whole AS (SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN l ON c.conv_id = l.conv_id),
        p AS (SELECT conv_id, len(turns) AS size, d, turns[:d] AS prefix FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
        k AS (SELECT conv_id, size, d, sha256(CAST(d AS VARCHAR) || ':' || CAST(to_json(prefix) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN sha256(CAST(d - 1 AS VARCHAR) || ':' || CAST(to_json(prefix[:d - 1]) AS VARCHAR)) END AS above, CASE WHEN d > 0 THEN octet_length(encode(prefix[d].text)) ELSE 0 END AS bytes FROM p),
        n AS (SELECT k, d, any_value(above) AS above, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN size = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM k GROUP BY k, d),
        ch AS (SELECT above, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above),
        v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM n LEFT JOIN ch ON n.k = ch.above),
        under AS (SELECT a.k, b.n_children = 0 AS leaf, b.saved FROM v b JOIN k own ON own.conv_id = b.conv_id AND own.d <= b.d JOIN v a ON a.k = own.k),
        sums AS (SELECT k, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM under GROUP BY k)
        SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
        FROM v JOIN sums ON v.k = sums.k LEFT JOIN v u ON u.k = v.above
    """,
}


def oracle_sql() -> dict[str, str]:
    from .licenses import TEMPLATES

    templates = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)
    return {name: sql.replace("{templates}", templates) for name, sql in ORACLES.items()}
