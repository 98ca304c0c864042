"""The queries of these operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm.exact_dedup import exact_dedup
from trapline.llm.hard_negatives import hard_negatives
from trapline.llm.language import identify
from trapline.llm.language_model import score_corpus
from trapline.llm.main_text import main_text
from trapline.llm.merkle import FIELDS, folded, leaf, manifest
from trapline.llm.mixing import BUDGET, CALIBRATION, MARGINS, ROUNDS, TEMPERATURE, mix
from trapline.llm.near_dedup import near_dedup
from trapline.llm.packing import pack
from trapline.llm.quality import quality
from trapline.llm.secret_scan import digest, scan
from trapline.llm.shared import table
from trapline.llm.tokens import token_counts
from trapline.llm.tool_calls import calls_of_conversations, link_all, other_turns


# What a call of the derived tool must look like.
SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["prompt", "words", "turn"],
        "additionalProperties": False,
        "properties": {
            "prompt": {"type": "string", "minLength": 1, "maxLength": 350},
            "words": {"type": "integer", "minimum": 5},
            "turn": {"type": "integer", "minimum": 0},
        },
    }
}


def op1_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return link_all(*calls_of_conversations(turns), SCHEMAS, others=other_turns(turns))


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup(table(spark, folder, "documents"), shingle_words=4)


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"))
    return mixed.withColumn("probability", F.round("probability", 6))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return digest(scan(table(spark, folder, "documents")))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op11_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_corpus(table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Witnesses of all documents, a fifth of which come back lower-cased."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    presented = leaf(*(lowered if name == "text" else F.col(name) for name in FIELDS))
    witnesses = manifest(table(spark, folder, "documents"), presented=F.when(tampered, presented))
    witnesses = witnesses.withColumns(
        {"presented": F.coalesce("presented", "leaf"), "proof_sha256": F.sha2("proof", 256)}
    )
    return folded(witnesses, "presented").select(
        *("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every hundredth vector's negatives, after every seventh has moved to the next label."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    query.__name__: query
    for query in (
        op1_tool_calls,
        op2_near_dedup,
        op3_exact_dedup,
        op4_token_counts,
        op5_language,
        op6_quality,
        op7_mixing,
        op8_main_text,
        op9_secrets,
        op10_packing,
        op11_lm_scores,
        op12_merkle_manifest,
        op13_hard_negatives,
    )
}


def _raking_sql() -> str:
    """Rounds of raking and of calibration, one common table each."""
    steps = [
        r"""measured AS (
          SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
           CASE WHEN coalesce(text, '') = '' THEN 'empty'
            WHEN 20 * (length(text) - length(regexp_replace(text, '[#$%&*]', '', 'g'))) >= length(text) THEN 'symbols'
            WHEN 20 * (length(text) - length(replace(text, '|', ''))) >= length(text) THEN 'table'
            WHEN 20 * (length(text) - length(replace(text, '!', ''))) >= length(text) THEN 'exclaim' ELSE 'prose' END AS topic,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
          FROM documents)""",
        """w0 AS MATERIALIZED (
          SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE AS weight FROM measured GROUP BY ALL)""",
    ]
    for margin in MARGINS:
        steps.append(
            f"""t_{margin} AS MATERIALIZED (
          SELECT {margin}, pow(tokens, {TEMPERATURE}) / sum(pow(tokens, {TEMPERATURE})) OVER () AS share
          FROM (SELECT {margin}, sum(tokens)::DOUBLE AS tokens FROM w0 GROUP BY 1) WHERE tokens > 0)"""
        )
    n = 0
    for _ in range(ROUNDS):
        for margin in MARGINS:
            steps.append(
                f"""w{n + 1} AS MATERIALIZED (
          SELECT source, lang, topic, tokens, weight * coalesce(CASE WHEN s > 0 THEN share * total / s END, 0) AS weight
          FROM (SELECT w.*, share, sum(weight) OVER (PARTITION BY w.{margin}) AS s, sum(tokens) OVER ()::DOUBLE AS total
           FROM w{n} w LEFT JOIN t_{margin} t ON t.{margin} = w.{margin}))"""
            )
            n += 1
    steps.append(
        f"""r AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio,
          sum(tokens) OVER () * {BUDGET} AS budget FROM w{n}),
        c0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS c)"""
    )
    for i in range(CALIBRATION):
        steps.append(
            f"""c{i + 1} AS MATERIALIZED (
          SELECT coalesce(greatest(any_value(c), (any_value(budget) - coalesce(sum(tokens) FILTER (c * ratio >= 1), 0))
           / nullif(sum(weight) FILTER (c * ratio < 1), 0)), any_value(c)) AS c FROM r, c{i})"""
        )
    steps.append(f"chances AS (SELECT source, lang, topic, least(1.0, c * ratio) AS probability FROM r, c{CALIBRATION})")
    return (
        "WITH "
        + ",\n        ".join(steps)
        + """
        SELECT doc_id, m.source, m.lang, m.topic, tokens, round(probability, 6) AS probability,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < probability AS kept
        FROM measured m JOIN chances USING (source, lang, topic)"""
    )


def _secrets_sql() -> str:
    """Spans by splitting at the matches; base kinds first."""
    kinds = {
        "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 20),
        "hex": (r"[0-9a-f]+", 0, 24),
        "private_key": (r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 0),
        "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
        "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
        "google": (r"AIza[A-Za-z0-9_-]{35}", 0, 0),
        "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    }
    parts = []
    for order, (kind, (pattern, group, least)) in enumerate(kinds.items()):
        parts.append(
            f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, ends - length(match) AS s, ends AS e FROM (
          SELECT doc_id, match, value, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id ORDER BY i) AS ends
          FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS match, unnest(v) AS value, unnest(g[1:len(m)]) AS gap
           FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS v,
             string_split_regex(text, '{pattern}') AS g FROM documents))) WHERE length(value) >= {least}"""
        )
    return (
        "WITH spans AS ("
        + "\n        UNION ALL ".join(parts)
        + """),
        grouped AS (
          SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS base,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
          FROM spans GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
         sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN grouped g ON g.doc_id = d.doc_id"""
    )


def _merkle_sql() -> str:
    """Levels of runs of 16, upwards for the nodes and along each leaf's way for proof and folded root; CRC-32 from its polynomial."""
    fields = [f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in FIELDS]
    lowered = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    steps = [
        """crc_table AS (SELECT list(list_reduce(list_concat([n], range(8)),
          lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n))""",
        f"""leaves AS MATERIALIZED (
          SELECT doc_id, coalesce('s' || source, 'n') AS tree, sha256(concat({", ".join(fields)})) AS leaf,
           CASE WHEN xor(4294967295, list_reduce(list_concat([4294967295],
             list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 5 = 0
            THEN sha256(concat({", ".join(fields).replace("text::", f"{lowered}::")})) END AS presented
          FROM documents, crc_table)""",
        """a0 AS MATERIALIZED (
          SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n,
           leaf AS node, '' AS proof, coalesce(presented, leaf) AS folded FROM leaves)""",
    ]

    def climb(side: str, depth: int) -> None:
        for i in range(depth):
            steps.append(
                f"""{side}_runs{i} AS MATERIALIZED (
          SELECT tree, pos // 16 AS run, list(node ORDER BY pos) AS nodes, any_value(n) AS n FROM {side}{i} WHERE n > 1 GROUP BY 1, 2)"""
            )
            steps.append(
                f"""{side}{i + 1} AS MATERIALIZED (
          SELECT tree, run AS pos, sha256(array_to_string(nodes, '')) AS node, (n + 15) // 16 AS n FROM {side}_runs{i}
          UNION ALL SELECT tree, pos, node, n FROM {side}{i} WHERE n = 1)"""
            )

    def walk(side: str, depth: int, start: str) -> str:
        for i in range(depth):
            steps.append(
                f"""{side}_walk{i} AS MATERIALIZED (
          SELECT doc_id, leaf, subroot, name, w.tree, pos // 16 AS pos,
           proof || coalesce(array_to_string(list_concat(nodes[1:pos % 16], nodes[pos % 16 + 2:]), ''), '') AS proof,
           CASE WHEN nodes IS NULL THEN folded ELSE sha256(concat(
            array_to_string(nodes[1:pos % 16], ''), folded, array_to_string(nodes[pos % 16 + 2:], ''))) END AS folded
          FROM {start} w LEFT JOIN {side}_runs{i} r ON r.tree = w.tree AND r.run = w.pos // 16)"""
            )
            start = f"{side}_walk{i}"
        return start

    climb("a", 6)
    steps.append(
        """b0 AS MATERIALIZED (
          SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, node FROM a6)"""
    )
    climb("b", 4)
    steps.append(
        """started AS (SELECT doc_id, leaf, b0.node AS subroot, name, a0.tree, a0.pos, proof, folded FROM a0 JOIN b0 ON b0.name = a0.tree)"""
    )
    inner = walk("a", 6, "started")
    steps.append(
        f"""moved AS (
          SELECT doc_id, leaf, subroot, b0.name, '' AS tree, b0.pos, proof, folded FROM {inner} w JOIN b0 ON b0.name = w.tree)"""
    )
    last = walk("b", 4, "moved")
    return (
        "WITH "
        + ",\n        ".join(steps)
        + f"""
        SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified
        FROM {last} w, b4"""
    )


ORACLE_SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
         doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_quality": r"""
        WITH words AS (
          SELECT doc_id, lang, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
          FROM documents),
        windows AS (
          SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS win
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM words)),
        repeated AS (
          SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
        covered AS (
          SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM repeated)
          GROUP BY doc_id),
        counted AS (
          SELECT w.doc_id, lang, source, len(words) AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
          FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id),
        measured AS (
          SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           word_chars / nullif(n_words, 0) AS m, n_symbols / nullif(word_chars, 0) AS s,
           n_dup_lines / nullif(n_lines, 0) AS d, n_repeat_words / nullif(n_words, 0) AS r FROM counted),
        sorted AS (
          SELECT lang, source, list_sort(list(m)) AS m, list_sort(list(s)) AS s, list_sort(list(d)) AS d, list_sort(list(r)) AS r,
           CAST(ceil(0.25 * count(*)) AS INT) AS low, CAST(ceil(0.75 * count(*)) AS INT) AS high
          FROM measured WHERE NOT base_failed GROUP BY lang, source),
        fences AS (
          SELECT lang, source, m[high] + greatest(3.0 * (m[high] - m[low]), 1.0) AS m_high,
           m[low] - greatest(3.0 * (m[high] - m[low]), 1.0) AS m_low, s[high] + greatest(3.0 * (s[high] - s[low]), 0.2) AS s_high,
           d[high] + greatest(3.0 * (d[high] - d[low]), 0.2) AS d_high, r[high] + greatest(3.0 * (r[high] - r[low]), 0.2) AS r_high
          FROM sorted),
        judged AS (
          SELECT a.*, concat_ws(',', CASE WHEN m > m_high OR m < m_low THEN 'mean_word_chars' END,
           CASE WHEN s > s_high THEN 'symbol_share' END, CASE WHEN d > d_high THEN 'dup_line_share' END,
           CASE WHEN r > r_high THEN 'repeat_share' END) AS outliers
          FROM measured a LEFT JOIN fences f ON a.lang IS NOT DISTINCT FROM f.lang AND a.source IS NOT DISTINCT FROM f.source)
        SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND outliers = '' AS kept, outliers
        FROM judged""",
    "op7_mixing": _raking_sql(),
    "op9_secrets": _secrets_sql(),
    "op12_merkle_manifest": _merkle_sql(),
    "op13_hard_negatives": """
        WITH v AS (
          SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
          FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
        positives AS (
          SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) AS k FROM scored WHERE same),
        negatives AS (
          SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id, n.r)::INT AS rank
          FROM positives p JOIN scored n ON n.anchor = p.anchor
          WHERE p.k <= 5 AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10""",
}
