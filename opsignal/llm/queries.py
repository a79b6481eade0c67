"""Queries over whole tables, one per operator, and DuckDB SQL where that can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsignal.llm import chat, decontam, exact, fertility, langid, lm, pieces, repair, simhash, suffix, toxicity, trie, urls
from opsignal.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document; fitted on a bounded sample of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.severity_grades(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model)


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of 3-word shingles and component of every document, links at 2 or fewer bits."""
    return simhash.groups(table(spark, sf_dir, "documents"), size=3, radius=2)


@query("op3_urls")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; the method learns from the urls that a rule decides."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, urls.fit(urls.labelled_by_rules(pages, RULES)))


@query("op4_pieces")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as counts and digests."""
    return piece_digests(table(spark, sf_dir, "documents"))


def piece_digests(docs: DataFrame) -> DataFrame:
    coded = pieces.encode(docs, piece_model())
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op5_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add-one and interpolated log10 probability of every document."""
    return lm.score(table(spark, sf_dir, "documents"))


@query("op6_suffix")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a passage of an earlier document repeats."""
    return suffix.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op7_exact",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
              doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal documents stays; the history is the distinct texts of the whole table."""
    return exact.dedup(table(spark, sf_dir, "documents"))


def _sql_escape(col: str) -> str:
    out = f"replace({col}, '&', '&amp;')"
    for mark in chat.DEFAULT.control:
        out = f"replace({out}, '{mark}', '{chat.ENTITIES[mark[0]]}{mark[1:]}')"
    return out


def _chat_sql() -> str:
    t = chat.DEFAULT
    marks = " ".join(f"WHEN role = '{n}' THEN {len(x.open + x.close)}" for n, x in t.turns.items())
    other = len(t.other.open + t.other_text + t.other.close)
    moves = " OR ".join(f"(before = '{a}' AND role = '{b}')" for a, b in t.moves)
    final = ", ".join(f"'{x}'" for x in t.final)
    # each state of the template's machine is named as the role that leads to it, so the role before is the state
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        o AS (SELECT *, row_number() OVER w - 1 AS pos, coalesce(lag(role) OVER w, '{t.start}') AS before FROM r
              WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        f AS (SELECT *, length({_sql_escape('text')}) + CASE {marks} ELSE {other} + length({_sql_escape('role')}) END AS wide,
                     NOT ({moves}) AS bad FROM o)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos)) AS loss_sha256,
               CAST(sum(wide) + count(*) - 1 AS BIGINT) AS formatted_chars,
               NOT bool_or(bad) AND max_by(role, pos) IN ({final}) AS valid, min(CASE WHEN bad THEN pos END) AS bad_turn
        FROM f GROUP BY conv_id"""


@query("op8_chat", _chat_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and one whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.summary(chat.format_conversations(rows.unionByName(extra)))


@query("op9_langid")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held = langid.is_held_out(F.col("doc_id"))
    model = langid.fit(docs.filter(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_decontam")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def crc32_sql(source: str) -> str:
    """Two further tables of a WITH RECURSIVE: crc(s, step, v), bit by bit, and crc_of(s, crc) of the strings `source` names as s."""
    return f"""crc AS (SELECT s, 0 AS step, 4294967295::BIGINT AS v FROM ({source})
        UNION ALL SELECT s, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
        FROM (SELECT s, step, CASE WHEN step % 8 = 0 THEN xor(v, ascii(s[step // 8 + 1])::BIGINT) ELSE v END AS x FROM crc WHERE step < 8 * length(s))),
        crc_of AS (SELECT s, xor(v, 4294967295::BIGINT) AS crc FROM crc WHERE step = 8 * length(s))"""


WORDS_SQL = "len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))"


@query(
    "op11_trie",
    f"""WITH RECURSIVE {crc32_sql("SELECT DISTINCT conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL")},
        c AS (SELECT s::BIGINT AS conv_id, crc % 4 AS h FROM crc_of),
        t AS (SELECT conv_id, turn, {WORDS_SQL} AS words, sha256(strlen(role) || ':' || role || text) AS digest
              FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t),
        b AS (SELECT c.conv_id, pos, words, digest FROM c JOIN r ON r.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
              UNION ALL SELECT conv_id, pos, words, digest FROM c JOIN r USING (conv_id) WHERE pos > h),
        d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth,
                     sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS path FROM b
              UNION ALL SELECT conv_id, 0, 0, '', 0, '' FROM c),
        m AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM d),
        n AS (SELECT path, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path),
        k AS (SELECT above AS path, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above),
        f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
        s AS (SELECT m.path, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens
              FROM f JOIN m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY m.path)
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
        FROM f JOIN s USING (path) LEFT JOIN f AS p ON p.path = f.above""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each with its block's first turns before its own."""
    return trie.nodes(trie.rebuilt(trie.turns(table(spark, sf_dir, "conversations"))))


@query(
    "op13_repair",
    f"""WITH RECURSIVE n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
        {crc32_sql("SELECT DISTINCT s FROM n")},
        d AS (SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
                     CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(CASE crc % 20 WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
              FROM n JOIN crc_of USING (s) WHERE crc % 20 <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS k,
                     left(role, 1) AS r, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tip FROM d),
        f AS (SELECT *, CASE WHEN tip = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                             WHEN tip NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                     k > 1 AND lag(r) OVER (PARTITION BY conv_id ORDER BY k) || r NOT IN ('su', 'ua', 'au') AS bad FROM o),
        mv AS (SELECT * FROM (VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')) AS m(s, r, t, forced)),
        i1 AS (SELECT s, t, chr(10) || forced || ':' AS txt FROM mv WHERE forced IS NOT NULL),
        ins AS (SELECT DISTINCT s, s AS t, 0 AS c, '' AS a, '' AS txt FROM mv UNION ALL SELECT s, t, 3, 'I', txt FROM i1
                UNION ALL SELECT x.s, y.t, 6, 'II', x.txt || y.txt FROM i1 x JOIN i1 y ON x.t = y.s),
        e AS (SELECT conv_id, k, s, s AS t, 4 AS c, 'D' AS a, '' AS txt FROM f, (SELECT DISTINCT s FROM mv)
              UNION ALL SELECT conv_id, k, s, t, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', chr(10) || forced || ':' || text
              FROM f, mv WHERE fault IN ('', 'truncated') AND forced IS NOT NULL
              UNION ALL SELECT conv_id, k, s, t, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text
              FROM f JOIN mv ON f.r = mv.r WHERE fault IN ('', 'truncated')),
        w AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS s, {{'c': 0, 'a': '', 'txt': ''}} AS x FROM f
              UNION ALL SELECT w.conv_id, e.k, e.t, min({{'c': x.c + ins.c + e.c, 'a': x.a || ins.a || e.a, 'txt': x.txt || ins.txt || e.txt}})
              FROM w JOIN ins ON w.s = ins.s JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.k = w.k + 1 AND e.s = ins.t GROUP BY w.conv_id, e.k, e.t),
        g AS (SELECT conv_id, max(k) AS k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                     count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal
              FROM f GROUP BY conv_id),
        z AS (SELECT g.*, min({{'c': x.c + ins.c, 'a': x.a || ins.a, 'txt': x.txt || ins.txt}}) AS x
              FROM g JOIN w ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.k = w.k JOIN ins ON ins.s = w.s WHERE ins.t IN (0, 3) GROUP BY ALL)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(substr(x.txt, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(rows), rows)


def vocabularies() -> fertility.Params:
    import public_tokenizers

    return fertility.Params(piece_model(), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op12_fertility")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether its tokens fit its language's band."""
    return fertility.judge(table(spark, sf_dir, "documents"), vocabularies())
