"""The queries of this subpackage, by name, and the SQL that some of them must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import chat, embeddings, infill, langid, media, mixing, quality, repair, sentencepiece, simhash, substring, toxicity, url_filter
from emberlog.llm.shared import table

#: Rules of the page filter: host, path, verdict.
PAGE_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.fit_and_identify(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_progressive_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, PAGE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.predict(docs, model).select("doc_id", "severity", "p_toxic", "toxic")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    return chat.chat_report(turns.unionByName(extra))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentencepiece.Pieces.load()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepiece.decode(sentencepiece.encode(docs, pieces), pieces)
    return back.select("doc_id", F.size("pieces").alias("n_pieces"), "pieces", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_report(repair.damaged(turns), turns.select("conv_id"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_report(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_repeated_passages, op2_language_mixture, op3_simhash, op4_progressive_media, op5_source_mixing, op6_url_filter, op7_toxicity, op8_embedding_near_dedup, op9_chat_windows, op10_sentencepiece, op11_conversation_repair, op12_quality_rules, op13_fill_in_middle)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word in RE2, and its count; the constants of the mixing and chat queries.
SQL_WORD = r"[^\x20\x09-\x0D]+"
BUDGET, HISTORY = 512, 128


def _escaped(text: str) -> str:
    return rf"regexp_replace(replace({text}, '\', '\\'), '([<\[]){chat.CONTROL_TAILS}', '\1\\\2', 'g')"


#: CRC-32 of a text in ASCII, from a table of the remainders of all bytes.
SQL_CRC_TABLE = "SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crc FROM range(256) bytes(b)"


def _crc32(text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"


#: Cost to the end of a conversation from each state (0: start, 1: after s, 2: after u, 3: after a) before row i, and with rows put in first.
SQL_NEXT = (2, 2, 3, 2)
SQL_FAR = 1000000000


def _row_cost(q: int) -> str:
    """Of the row's own edits in state q, with the costs x0 to x3 behind it."""
    fits = f"initial = '{'uuau'[q]}'"
    keep = f"WHEN {fits} THEN x{SQL_NEXT[q]}" + (" WHEN initial = 's' THEN x1" if q == 0 else "")
    return f"least(4 + x{q}, CASE WHEN gone THEN {SQL_FAR} ELSE cut_off + least(3 + x{SQL_NEXT[q]}, CASE {keep} ELSE {SQL_FAR} END) END)"


def _put_in(q: int, c: str) -> str:
    """With turns put in first: once, or twice."""
    a, b = SQL_NEXT[q], SQL_NEXT[SQL_NEXT[q]]
    return f"least({c}{q}, 3 + {c}{a}, 6 + {c}{b})"


ORACLES = {
    "op11_conversation_repair": f"""
        WITH RECURSIVE crcs AS ({SQL_CRC_TABLE}),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crcs),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
              FROM k WHERE kind != 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
        f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM o),
        r AS (SELECT *, left(role, 1) AS initial, last = '' AS blank, last != '' AND nth > 1 AS dup, last NOT IN ('', '.', '!', '?') AND nth = 1 AS short,
                     lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM f),
        e AS (SELECT *, blank OR dup AS gone, CASE WHEN short THEN 3 ELSE 0 END AS cut_off FROM r),
        back(conv_id, i, x0, x1, x2, x3) AS (
            SELECT conv_id, n + 1, 0, 6, 3, 0 FROM (SELECT DISTINCT conv_id, n FROM e)
            UNION ALL
            SELECT conv_id, i, {", ".join(_put_in(q, "c") for q in range(4))}
            FROM (SELECT e.conv_id, e.i, {", ".join(f"{_row_cost(q)} AS c{q}" for q in range(4))}
                  FROM back JOIN e ON e.conv_id IS NOT DISTINCT FROM back.conv_id AND e.i = back.i - 1)),
        costs AS (SELECT *, [x0, x1, x2, x3] AS x FROM back),
        steps AS (
            SELECT a.conv_id, a.i, a.x AS here, b.x AS behind, e.initial, e.gone, e.cut_off, e.role, e.text, e.n
            FROM costs a LEFT JOIN costs b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = a.i + 1 LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id AND e.i = a.i),
        walk(conv_id, i, q, step, edit, line) AS (
            SELECT conv_id, 1::BIGINT, 0, 0, '', NULL::VARCHAR FROM (SELECT DISTINCT conv_id FROM e)
            UNION ALL
            SELECT w.conv_id, CASE WHEN w.can = 'I' THEN w.i ELSE w.i + 1 END,
                   CASE WHEN w.can = 'D' THEN w.q WHEN w.can = 'K' AND w.q = 0 AND w.initial = 's' THEN 1 ELSE [2, 2, 3, 2][w.q + 1] END, w.step + 1, w.can,
                   CASE w.can WHEN 'D' THEN NULL WHEN 'K' THEN w.role || ':' || w.text ELSE CASE WHEN w.q = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN w.can = 'R' THEN w.text ELSE '' END END
            FROM (SELECT walk.conv_id, walk.i, walk.q, walk.step, s.role, s.text, s.initial, CASE
                      WHEN s.role IS NOT NULL AND 4 + s.behind[walk.q + 1] = s.here[walk.q + 1] THEN 'D'
                      WHEN 3 + s.here[[2, 2, 3, 2][walk.q + 1] + 1] = s.here[walk.q + 1] THEN 'I'
                      WHEN s.role IS NOT NULL AND NOT s.gone AND s.initial = ['u', 'u', 'a', 'u'][walk.q + 1] AND s.cut_off + s.behind[[2, 2, 3, 2][walk.q + 1] + 1] = s.here[walk.q + 1] THEN 'K'
                      WHEN s.role IS NOT NULL AND NOT s.gone AND s.initial = 's' AND walk.q = 0 AND s.cut_off + s.behind[2] = s.here[1] THEN 'K'
                      WHEN s.role IS NOT NULL THEN 'R' END AS can
                  FROM walk JOIN steps s ON s.conv_id IS NOT DISTINCT FROM walk.conv_id AND s.i = walk.i) w
            WHERE w.can IS NOT NULL),
        audits AS (SELECT conv_id, string_agg(edit, '' ORDER BY step) AS audit, coalesce(string_agg(line, chr(10) ORDER BY step), '') AS lines FROM walk WHERE step > 0 GROUP BY conv_id),
        told AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (dup)::BIGINT AS duplicate,
                   count(*) FILTER (short)::BIGINT AS truncated, count(*) FILTER (i > 1 AND prev || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
            FROM e GROUP BY conv_id),
        ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(x0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
        FROM ids LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN audits ON audits.conv_id IS NOT DISTINCT FROM ids.conv_id
             LEFT JOIN back ON back.conv_id IS NOT DISTINCT FROM ids.conv_id AND back.i = 1""",
    "op13_fill_in_middle": """
        WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
        u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, list_transform(range(4), lambda k: ('0x' || substr(x, 1 + 8 * k, 8))::BIGINT) AS h FROM h),
        n AS (SELECT *, len(lines)::BIGINT AS n, least(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS a, greatest(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        c AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM n)
        SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form != 'plain' THEN length(middle)::BIGINT END AS middle_chars,
               sha256(CASE form WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM c""",
    "op6_url_filter": f"""
        WITH rules(rhost, rpath, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in PAGE_RULES)}),
        cutoff AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cutoff),
        fits AS (
            SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict, length(r.rhost || r.rpath) AS n
            FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC NULLS LAST) = 1""",
    "op5_source_mixing": f"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SQL_WORD}')), 0)::BIGINT AS size,
                   ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT AS key
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM sized GROUP BY source),
        w AS (SELECT *, [3.0, 1.0, 2.0][1 + (pos - 1) % 3]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
        o AS (SELECT *, cap / w AS ratio FROM w),
        p AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (ORDER BY ratio, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price FROM o),
        f AS (SELECT source, source_size, CASE WHEN price >= ratio THEN cap
                ELSE least(cap, w * (SELECT price FROM p WHERE price < ratio ORDER BY ratio, pos LIMIT 1)) END AS target FROM p),
        placed AS (
            SELECT doc_id, size, source_size, target, floor(target / nullif(source_size, 0)) AS epochs,
                   coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized JOIN f ON sized.source IS NOT DISTINCT FROM f.source)
        SELECT doc_id, size, source_size, target,
               (coalesce(epochs, 0) * size + greatest(0, least(size, floor(target) - coalesce(epochs, 0) * source_size - before)))::BIGINT AS taken
        FROM placed""",
    "op8_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
        c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
        SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id""",
    "op9_chat_windows": f"""
        WITH RECURSIVE t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        told AS (
            SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
            FROM t GROUP BY conv_id),
        k AS (
            SELECT *, len(regexp_extract_all(text, '{SQL_WORD}')) + 1 AS k, row_number() OVER c AS i,
                   length(replace({_escaped("role")}, chr(10), '\\n')) + length({_escaped("text")}) + {len(chat.START) + len(chat.END) + 2} AS chars
            FROM t WINDOW c AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        p AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p,
                     i = 1 AND role = 'system' AND k * 2 <= {BUDGET} AS sys FROM k),
        s AS (SELECT *, p // {chat.CHAPTER * BUDGET} AS chapter, coalesce(sum(CASE WHEN sys THEN k END) OVER w, 0) AS sys_k, coalesce(sum(CASE WHEN sys THEN chars END) OVER w, 0) AS sys_chars,
                     coalesce(min(CASE WHEN NOT sys THEN i END) OVER h, i) AS first, coalesce(p - min(CASE WHEN NOT sys THEN p END) OVER h, 0) AS past
              FROM p WINDOW w AS (PARTITION BY conv_id), h AS (PARTITION BY conv_id ORDER BY p RANGE BETWEEN {HISTORY} PRECEDING AND CURRENT ROW)),
        u AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE sys_k END AS kept FROM s),
        v AS (SELECT *, CASE WHEN kept + past + k <= {BUDGET} THEN past ELSE 0 END AS held FROM u),
        nxt AS (SELECT a.conv_id, a.i, min(b.i) AS stop FROM v a LEFT JOIN v b ON b.conv_id = a.conv_id AND b.i > a.i AND (b.chapter != a.chapter OR a.kept + a.held + b.p + b.k - a.p > {BUDGET}) GROUP BY a.conv_id, a.i),
        w AS (SELECT conv_id, 1::BIGINT AS i FROM told UNION ALL SELECT w.conv_id, nxt.stop FROM w JOIN nxt ON nxt.conv_id = w.conv_id AND nxt.i = w.i WHERE nxt.stop IS NOT NULL),
        c AS (SELECT v.conv_id, v.i, any_value(CASE WHEN v.i > 1 THEN v.sys_chars ELSE 0 END) + sum(x.chars) AS chars
              FROM w JOIN v ON v.conv_id = w.conv_id AND v.i = w.i JOIN nxt ON nxt.conv_id = v.conv_id AND nxt.i = v.i
              JOIN v x ON x.conv_id = v.conv_id AND x.i >= CASE WHEN v.held > 0 THEN v.first ELSE v.i END AND (nxt.stop IS NULL OR x.i < nxt.stop) GROUP BY v.conv_id, v.i)
        SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
               (SELECT sum(chars)::BIGINT FROM c WHERE c.conv_id = told.conv_id) AS formatted_chars
        FROM told""",
}
