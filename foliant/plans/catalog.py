"""All queries on the given tables, with their SQL counterparts.

Each query applies one operator to a whole table. Where the tables lack a form (data URLs, ink marks,
escape codes), query and SQL add the same literals to every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import cells, shapes
from foliant.functions import text as T
from foliant.operators import archive, blocks, context, files, layout, transcript, writing
from foliant.session import importable, scratch, settled, shared, spread
from foliant.sources import frame_store
from foliant.sources import frames as frame_files_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEY = bytes(range(32))
#: Capacities of 176-pixel pages of the high and the low tier, and a page budget, so that all tiers occur.
HIGH, LOW, MOST = 160, 220, 11


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: importable(spark).read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- Messages and sections -------------------------------------------------------------------------

SAID = """said AS (
  SELECT conv_id, turn, role, translate(text, chr(14) || chr(15), '') AS text FROM conversations
  WHERE (role = 'user' AND text <> '') OR (role = 'assistant' AND regexp_matches(translate(text, chr(14) || chr(15), ''), '\\S'))
)"""
SECTIONS = (
    SAID
    + """, parts AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '»user:' ELSE '»ai:' END AS prefix, text FROM said),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM (SELECT *, CASE WHEN lag(prefix) OVER (PARTITION BY conv_id ORDER BY turn) = prefix THEN 0 ELSE 1 END AS starts FROM parts)),
spaced AS (SELECT *, CASE WHEN lag(text) OVER w IS NULL OR ends_with(lag(text) OVER w, chr(10)) OR starts_with(text, chr(10)) THEN '' ELSE chr(10) END AS gap FROM islands WINDOW w AS (PARTITION BY conv_id, section ORDER BY turn)),
sections AS (SELECT conv_id, CAST(section AS BIGINT) AS section, prefix, prefix || string_agg(gap || text, '' ORDER BY turn) AS text FROM spaced GROUP BY conv_id, section, prefix)"""
)
TRANSCRIPT = SECTIONS + ", transcript AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY section) AS text FROM sections GROUP BY conv_id)"
NORMAL = TRANSCRIPT + ", normal AS (SELECT conv_id, trim(regexp_replace(regexp_replace(text, '\\s*\\n\\s*', '█', 'g'), '\\s+', ' ', 'g'), ' █') AS text FROM transcript)"


@query(f"WITH {SAID} SELECT conv_id, turn, role, text FROM said")
def messages_filtered(t):
    return transcript.said(t("conversations")).select("conv_id", "turn", "role", "text")


@query(f"WITH {SECTIONS} SELECT conv_id, section, prefix, text FROM sections")
def sections_merged(t):
    return transcript.sections(transcript.tagged(t("conversations"))).withColumn("section", F.col("section").cast("long"))


@query(f"WITH {TRANSCRIPT} SELECT conv_id, text FROM transcript")
def transcripts(t):
    return transcript.transcripts(t("conversations"))


LATER_FIRST = "FROM (SELECT * REPLACE (CASE WHEN turn >= 2 THEN turn - 2 ELSE turn + 1000 END AS turn) FROM conversations)"


@query(f"WITH {TRANSCRIPT.replace('FROM conversations', LATER_FIRST)} SELECT conv_id, text FROM transcript")
def message_slices(t):
    """Two slices of each conversation, both with turns from 0: the messages behind the second turn, and behind these the first two."""
    messages = t("conversations")
    later = messages.where("turn >= 2").withColumn("turn", F.col("turn") - 2)
    return transcript.transcripts(transcript.in_slices(later, messages.where("turn < 2")))


@query("SELECT conv_id, prefix, count(*) AS n FROM (SELECT conv_id, CASE role WHEN 'user' THEN '»user:' WHEN 'assistant' THEN '»ai:' ELSE 'none' END AS prefix FROM conversations) GROUP BY ALL")
def section_prefix(t):
    tag = F.when(F.col("role") == "user", T.SECTION_TAGS["user"]).when(F.col("role") == "assistant", T.SECTION_TAGS["ai"]).otherwise("none")
    return t("conversations").groupBy("conv_id", tag.alias("prefix")).agg(F.count("*").alias("n"))


def normal(t) -> DataFrame:
    return transcript.transcripts(t("conversations")).select("conv_id", T.normalize_latin(F.col("text")).alias("text"))


# --- Tool calls: events are calls, documents are results ---------------------------------------------

CALLS = "calls AS (SELECT event_id % 40 AS conv_id, event_id AS call_id, event_id * 7 % 1000 AS seq, event_type AS name, CAST(user_id AS VARCHAR) AS user_id, coalesce(props, 'undefined') AS props FROM events)"
RESULTS = "results AS (SELECT doc_id % 40 AS conv_id, doc_id AS call_id, doc_id * 3 % 1000 AS seq, coalesce(text, '') AS text FROM documents)"
BODY = "'<out>' || chr(10) || chr(14) || CASE WHEN length({0}) <= 2000 THEN {0} ELSE left({0}, 1200) || ' […' || (length({0}) - 2000) || 'ch elided…] ' || right({0}, 800) END || chr(15) || chr(10) || '</out>'"


def calls(t) -> DataFrame:
    args = F.array(F.struct(F.lit("user").alias("k"), F.col("user_id").cast("string").alias("v_json")), F.struct(F.lit("props").alias("k"), F.coalesce("props", F.lit("undefined")).alias("v_json")))
    return t("events").select((F.col("event_id") % 40).alias("conv_id"), F.col("event_id").alias("call_id"), (F.col("event_id") * 7 % 1000).alias("seq"), F.col("event_type").alias("name"), args.alias("args"))


def results(t) -> DataFrame:
    return t("documents").select((F.col("doc_id") % 40).alias("conv_id"), F.col("doc_id").alias("call_id"), (F.col("doc_id") * 3 % 1000).alias("seq"), F.coalesce("text", F.lit("")).alias("text"))


@query(
    f"WITH {CALLS}, {RESULTS} SELECT c.conv_id, c.call_id, c.seq, c.name || '(user=' || c.user_id || ', props=' || c.props || ')' || CASE WHEN r.text <> '' THEN chr(10) || {BODY.format('r.text')} ELSE '' END AS text "
    "FROM calls c LEFT JOIN results r USING (conv_id, call_id)"
)
def tool_call_left_join(t):
    return transcript.calls_with_results(calls(t), results(t))


@query(
    f"WITH {CALLS}, {RESULTS}, first AS (SELECT conv_id, call_id, min(seq) AS call_seq FROM calls WHERE call_id % 3 > 0 GROUP BY ALL) "
    f"SELECT r.conv_id, r.call_id, r.seq, chr(10) || {BODY.format('r.text')} AS text FROM results r LEFT JOIN first f USING (conv_id, call_id) WHERE r.text <> '' AND (f.call_seq IS NULL OR f.call_seq > r.seq)"
)
def orphan_results(t):
    return transcript.orphans(calls(t).where("call_id % 3 > 0"), results(t))


@query("SELECT conv_id, call_id, max_by(text, seq) AS result FROM (SELECT doc_id % 7 AS conv_id, doc_id % 100 AS call_id, doc_id AS seq, text FROM documents WHERE text <> '') GROUP BY ALL")
def last_result_wins(t):
    shaped = t("documents").select((F.col("doc_id") % 7).alias("conv_id"), (F.col("doc_id") % 100).alias("call_id"), F.col("doc_id").alias("seq"), "text")
    return transcript.last_results(shaped)


# --- Scalar text functions -----------------------------------------------------------------------------


def over_documents(expression: Callable[[Column], Column], before: str = "", after: str = ""):
    def run(t) -> DataFrame:
        body = F.concat(F.lit(before), F.coalesce("text", F.lit("")), F.lit(after))
        return t("documents").select("doc_id", expression(body).alias("text"))

    return run


def scalar(name: str, expression: Callable[[Column], Column], sql: str, before: str = "", after: str = "") -> None:
    """A query over all document texts; ``sql`` uses {0} for the text."""
    run = over_documents(expression, before, after)
    run.__name__ = name
    source = f"(SELECT doc_id, {quoted(before)} || coalesce(text, '') || {quoted(after)} AS b FROM documents)"
    query(f"SELECT doc_id, {sql.format('b')} AS text FROM {source}")(run)


URL = "data:image/png;base64,"
scalar("truncate_middle", lambda c: T.truncate_middle(c, 2000, 0.6), "CASE WHEN length({0}) <= 2000 THEN {0} ELSE left({0}, 1200) || ' […' || (length({0}) - 2000) || 'ch elided…] ' || right({0}, 800) END")
scalar("strip_markers", T.strip_marks, "translate({0}, chr(14) || chr(15), '')", "a\u000eb\u000f")
scalar("plain_text", T.plain_text, "replace(translate({0}, chr(14) || chr(15), ''), '█', chr(10))", "a█\u000eb")
scalar("elide_data_urls", T.elide_data_urls, "replace(replace({0}, '(data:image/png;base64,QUJDREVG)', '([data URL omitted: image/png, 8 base64 chars]'), 'data:text/x;base64,AAAA BBBB', '[data URL omitted: text/x, 8 base64 chars]')", "x (data:image/png;base64,QUJDREVG) y data:image/png;base64,abc! data:text/x;base64,AAAA BBBB. ")
scalar("strip_ansi", T.strip_ansi, "regexp_replace({0}, chr(27) || '\\[[0-9;?]*[ -/]*[@-~]|' || chr(27) || '\\][^\\x07\\x1b]*\\x07', '', 'g')", "\u001b[1;31mred\u001b[0m \u001b]0;title\u0007")
scalar("collapse_space", T.collapse_space, "trim(regexp_replace(regexp_replace({0}, '\\s*\\n\\s*', '█', 'g'), '\\s+', ' ', 'g'), ' █')", "  a  b\n\n\nc ", " \n\t")
scalar("fold_signs", T.fold_signs, "replace(replace(replace(replace(replace({0}, '“', '\"'), '”', '\"'), '→', '->'), '…', '...'), '✅', '[OK]')", "“a” → b… ✅ ")
scalar("fold_boxes", T.fold_boxes, "replace(replace(replace(replace({0}, '│', '|'), '─', '-'), '┌', '+'), '╬', '+')", "┌──│╬")
scalar("normalize_latin1", T.normalize_latin, "trim(regexp_replace(replace(replace(regexp_replace({0}, '\\s*\\n\\s*', '█', 'g'), '→', '->'), '│', '|'), '\\s+', ' ', 'g'), ' █')", "\n a → │ ")
STOPS = "|".join(T.STOPWORDS)
scalar("dim_stopwords", T.dim_stopwords, "(SELECT string_agg(CASE WHEN list_contains(string_split('" + STOPS + "', '|'), lower(w)) THEN chr(14) || w || chr(15) ELSE w END, '' ORDER BY i) FROM (SELECT unnest(s) AS w, unnest(range(len(s))) AS i FROM (SELECT regexp_extract_all({0}, '[a-zA-ZÀ-ÖØ-öø-ÿ]+|[^a-zA-ZÀ-ÖØ-öø-ÿ]+') AS s)))", "The quick fox, ")
SIZE = "CASE WHEN {0} >= 1000000 THEN (({0} + 50000) // 100000 // 10) || '.' || (({0} + 50000) // 100000 % 10) || ' MB' WHEN {0} >= 1000 THEN (({0} + 50) // 100 // 10) || '.' || (({0} + 50) // 100 % 10) || ' KB' ELSE {0} || ' B' END"
scalar("format_bytes", lambda c: T.format_bytes(F.length(c).cast("long") * 37), SIZE.format("(length({0}) * 37)"))


@query(
    "WITH s AS (SELECT doc_id, '»user:a' || chr(10) || chr(10) || '»think:' || replace(coalesce(text, ''), chr(10), '█') || chr(10) || chr(10) || '»ai:b' AS b FROM documents), "
    "g AS (SELECT doc_id, string_split(b, '█') AS g FROM s) "
    "SELECT doc_id, array_to_string(list_filter(list_transform(g, lambda x, i: CASE WHEN i = 1 AND len(g) = 1 THEN '»user:a' || chr(10) || chr(10) || '»ai:b' WHEN i = 1 THEN '»user:a' ELSE x END), lambda x: x <> ''), '█') AS text FROM g"
)
def strip_thinking(t):
    body = F.concat(F.lit("»user:a\n\n»think:"), F.translate(F.coalesce("text", F.lit("")), "\n", T.CELL), F.lit("\n\n»ai:b"))
    return t("documents").select("doc_id", T.strip_thinking(body).alias("text"))


@query("SELECT doc_id, CASE WHEN length(b) > 24000 THEN left(b, 12000) || chr(10) || '[…' || (length(b) - 24000) || ' characters of the archive are left out here…]' || chr(10) || right(b, 12000) ELSE b END AS text FROM (SELECT doc_id, coalesce(text, '') || ' end' AS b FROM documents)")
def text_replay(t):
    source = F.concat(F.lit("head"), F.coalesce("text", F.lit("")), F.lit(" end"), F.lit("tail"))
    made = t("documents").select("doc_id", source.alias("text"), F.lit("head").alias("head"), F.lit("tail").alias("tail"))
    return T.bounded_replay(made, "text", "head", "tail", F.lit(True)).select("doc_id", "text")


@query("SELECT doc_id, to_base64(encode(coalesce(text, ''))) AS data, true AS same FROM documents")
def base64_frames(t):
    data = F.regexp_replace(F.base64(F.coalesce("text", F.lit("")).cast("binary")), r"[\r\n]", "")
    return t("documents").select("doc_id", data.alias("data"), (F.unbase64(data) == F.coalesce("text", F.lit("")).cast("binary")).alias("same"))


@query(
    "SELECT doc_id, doc_id % 40 / visible AS ratio, 20 * (doc_id % 40) <= visible AS is_safe, visible AS n FROM (SELECT doc_id, CAST(length(replace('cafe' || repeat('?', doc_id % 40) || ' ' || trim(regexp_replace(regexp_replace(coalesce(text, '') || ' end', '\\s*\\n\\s*', '█', 'g'), '\\s+', ' ', 'g'), ' █'), '█', '')) AS BIGINT) AS visible FROM documents)"
)
def renderability(t):
    """Share of characters that would print as ``?``, over texts behind up to 39 ideographs that no font has."""
    from foliant.functions import unicode

    lost = F.expr("repeat('日', cast(doc_id % 40 as int))")
    body = F.concat(F.lit("cafe"), lost, F.lit(" "), F.ltrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\A\s+", "")), F.lit(" end"))
    found = t("documents").select("doc_id", unicode.normalize_udf()(body).alias("n"))
    return found.select("doc_id", unicode.lost_share(F.col("n")).alias("ratio"), unicode.renders_safely(F.col("n")).alias("is_safe"), F.col("n.visible").alias("n"))


IDEOGRAPHS = "CAST(CASE doc_id % 3 WHEN 0 THEN length(coalesce(text, '')) // 8 + 3 WHEN 1 THEN length(coalesce(text, '')) // 20 ELSE 0 END AS BIGINT)"
HEAVY = f"heavy AS (SELECT doc_id, w >= 8 AND 4 * w >= v + w AS heavy FROM (SELECT doc_id, 3 * {IDEOGRAPHS} AS w, length(regexp_replace(coalesce(text, ''), '[ \\x00-\\x1f\\x7f-\\x9f█]', '', 'g')) AS v FROM documents))"


def with_ideographs(t) -> DataFrame:
    """Texts with ideographs behind them: none, few or many for their length."""
    n, text = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    many = F.when(n == 0, F.floor(F.length(text) / 8) + 3).when(n == 1, F.floor(F.length(text) / 20)).otherwise(0)
    return t("documents").select("doc_id", F.concat(text, F.repeat(F.lit("日本語"), many.cast("int"))).alias("text"))


@query(f"WITH {HEAVY} SELECT doc_id, heavy FROM heavy")
def cjk_heavy(t):
    return with_ideographs(t).select("doc_id", cells.is_ideographic(F.col("text")).alias("heavy"))


@query(f"WITH {HEAVY} SELECT doc_id, CASE WHEN doc_id % 5 > 0 AND (doc_id % 2 = 0 OR heavy) AND doc_id % 7 > 0 THEN 'silver16-bw' ELSE '8on16-bw' END AS shape FROM heavy")
def shape_by_text(t):
    """The shape for a text: chosen ones (every fifth) stay, texts that the first font does not print (even ones) and ideographic ones move where the wide font prints them."""
    n = F.col("doc_id")
    shape = writing.shape_for_text(F.lit("8on16-bw"), n % 5 == 0, n % 2 > 0, n % 7 > 0, cells.is_ideographic(F.col("text")))
    return with_ideographs(t).select("doc_id", shape.alias("shape"))


# --- Files ------------------------------------------------------------------------------------------------

OPS = """ops AS (
  SELECT p_partkey % 40 AS conv_id, p_name AS path, CASE p_partkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'written' ELSE 'edited' END AS op FROM part
  UNION ALL SELECT page_id % 40, url, 'read' FROM pages UNION ALL SELECT p_partkey % 40, p_name, 'read' FROM part WHERE p_partkey % 5 = 0
), kept AS (SELECT * FROM ops WHERE NOT regexp_matches(path, '(?i)[a-z][a-z0-9+.-]*://')),
modes AS (SELECT conv_id, path, CASE WHEN bool_or(op = 'read') AND bool_or(op <> 'read') THEN 'read+write' WHEN bool_or(op <> 'read') THEN 'written' ELSE 'read' END AS mode FROM kept GROUP BY ALL)"""


def operations(t) -> DataFrame:
    op = F.when(F.col("p_partkey") % 3 == 0, "read").when(F.col("p_partkey") % 3 == 1, "written").otherwise("edited")
    part = t("part").select((F.col("p_partkey") % 40).alias("conv_id"), F.col("p_name").alias("path"), op.alias("op"), "p_partkey")
    pages = t("pages").select((F.col("page_id") % 40).alias("conv_id"), F.col("url").alias("path"), F.lit("read").alias("op"))
    again = part.where("p_partkey % 5 = 0").select("conv_id", "path", F.lit("read").alias("op"))
    return part.drop("p_partkey").unionByName(pages).unionByName(again)


@query(f"WITH {OPS} SELECT conv_id, path, mode FROM modes")
def file_modes(t):
    return files.modes(operations(t))


@query(
    f"WITH {OPS}, lists AS (SELECT conv_id, count(*) AS n_files, list(path || ' (' || mode || ')' ORDER BY path) AS l FROM modes GROUP BY conv_id) "
    "SELECT conv_id, n_files, array_to_string(l[1:20], chr(10)) || CASE WHEN n_files > 20 THEN chr(10) || '[…' || (n_files - 20) || ' more files elided…]' ELSE '' END AS files FROM lists"
)
def file_lists(t):
    return files.listing(operations(t))


@query("SELECT page_id, NOT regexp_matches(url, '(?i)[a-z][a-z0-9+.-]*://') AS is_path, NOT regexp_matches(substr(url, strpos(url, '/') + 2), '(?i)[a-z][a-z0-9+.-]*://') AS rest_is_path FROM pages")
def url_scheme_filter(t):
    rest = F.substring("url", F.instr("url", "/") + 2, F.length("url"))
    return t("pages").select("page_id", files.is_path(F.col("url")).alias("is_path"), files.is_path(rest).alias("rest_is_path"))


# --- Shapes -------------------------------------------------------------------------------------------------

SHAPES = (
    "shapes(variant, font, cell_w, cell_h, ink, dim, columns, repeat, frame_size) AS (VALUES "
    + ", ".join(f"('{c[0]}', '{c[1]}', {c[2]}, {c[3]}, '{c[5]}', {str(c[6]).lower()}, {c[7]}, {c[8]}, {c[9]})" for c in shapes.CATALOG) + ")"
)
NAMES = ["claude-fable", "claude-opus-4-7", "claude-opus-4-20250514", "claude-opus-5", "claude-3-sonnet", "gemini-3-pro", "gpt-5", "kimi-k2", "glm-4.6", "llama"]
APIS = ["anthropic-messages", "bedrock-x", "google-ai", "openai-chat", "azure-openai-y", "other"]
READERS = (
    "readers AS (SELECT c_custkey, ['" + "', '".join(NAMES) + f"'][c_custkey % {len(NAMES)} + 1] AS model_id, ['" + "', '".join(APIS) + f"'][c_custkey % {len(APIS)} + 1] AS api, "
    "CASE WHEN c_custkey % 11 = 0 THEN '8x13-bw' END AS forced FROM customer), "
    "fam AS (SELECT *, CASE WHEN starts_with(api, 'anthropic') OR starts_with(api, 'bedrock') THEN 'anthropic' WHEN starts_with(api, 'google') THEN 'google' WHEN starts_with(api, 'openai') OR starts_with(api, 'azure-openai') THEN 'openai' ELSE 'unknown' END AS family FROM readers), "
    "ruled AS (SELECT *, CASE WHEN forced IS NOT NULL THEN forced WHEN model_id LIKE 'glm%' THEN '8on16-bw' WHEN model_id LIKE 'claude%' THEN '11on16-bw' WHEN model_id = 'llama' AND family = 'anthropic' THEN '11on16-bw' ELSE '8on22-bw' END AS variant, "
    "CASE WHEN forced IS NOT NULL THEN 0 WHEN model_id IN ('claude-fable', 'claude-opus-4-7', 'claude-opus-5') THEN 1932 WHEN model_id LIKE 'gemini%' THEN 2048 ELSE 0 END AS edge FROM fam)"
)


def readers(t) -> DataFrame:
    pick = lambda names: F.array(*[F.lit(n) for n in names])[(F.col("c_custkey") % len(names)).cast("int")]
    return t("customer").select("c_custkey", pick(NAMES).alias("model_id"), pick(APIS).alias("api"), F.when(F.col("c_custkey") % 11 == 0, "8x13-bw").alias("forced"))


@query(f"WITH {READERS}, {SHAPES} SELECT r.c_custkey, r.family, r.variant, CAST(CASE WHEN r.edge > 0 THEN r.edge ELSE s.frame_size END AS INTEGER) AS frame_size FROM ruled r JOIN shapes s USING (variant)")
def resolve_shape(t):
    return shapes.for_reader(readers(t)).select("c_custkey", "family", "variant", "frame_size")


OWN_SHAPE = "CASE WHEN c_custkey % 11 = 0 THEN '8x13-bw' END AS forced"
CHOSEN_SHAPE = "CASE WHEN c_custkey % 3 = 0 THEN ['" + "', '".join(c[0] for c in shapes.CATALOG) + f"'][c_custkey // 3 % {len(shapes.CATALOG)} + 1] END AS forced"
SHAPED = (
    f"{READERS.replace(OWN_SHAPE, CHOSEN_SHAPE)}, {SHAPES}"
    """, shaped AS (SELECT r.c_custkey, r.family, s.* REPLACE (CASE WHEN r.edge > 0 THEN r.edge ELSE s.frame_size END AS frame_size) FROM ruled r JOIN shapes s USING (variant)),
grid AS (SELECT *, columns * grid_cols * grid_rows AS capacity FROM (SELECT *, CASE WHEN columns = 2 THEN (frame_size // cell_w - 3) // 2 ELSE frame_size // cell_w END AS grid_cols,
  greatest(1, CAST(floor((frame_size - cell_h) / cell_h / repeat) AS BIGINT)) AS grid_rows FROM shaped)),
priced AS (SELECT *, CAST(CASE family WHEN 'google' THEN 1120 WHEN 'openai' THEN ceil(1.2 * least(ceil(frame_size / 32) ** 2, 10000)) ELSE ceil(1.05 * least(ceil(frame_size / 28) ** 2, 4784)) END AS BIGINT) AS tokens FROM shaped)"""
)


def shaped(t) -> DataFrame:
    """The shapes of all readers; every third has chosen one of the catalog."""
    chosen = F.array(*[F.lit(c[0]) for c in shapes.CATALOG])[(F.floor(F.col("c_custkey") / 3) % len(shapes.CATALOG)).cast("int")]
    return shapes.for_reader(readers(t).withColumn("forced", F.when(F.col("c_custkey") % 3 == 0, chosen)))


@query(f"WITH {SHAPED} SELECT c_custkey, variant, CAST(grid_cols AS BIGINT) AS grid_cols, CAST(grid_rows AS BIGINT) AS grid_rows, CAST(capacity AS BIGINT) AS capacity FROM grid")
def shape_geometry(t):
    """Columns, rows and characters of the pages each reader gets."""
    return shapes.grid(shaped(t)).select("c_custkey", "variant", "grid_cols", "grid_rows", "capacity")


@query(
    f"WITH {SHAPED} SELECT c_custkey, tokens, font || ' ' || cell_w || 'x' || cell_h || ' ' || CASE WHEN columns = 2 THEN 'two-column' WHEN repeat > 1 THEN 'repeat x' || repeat ELSE 'grid' END || ' @' || frame_size || 'px, ' || ink || CASE WHEN dim THEN '+dim' ELSE '' END || ' ink, ~' || format('{{:,}}', tokens) || ' tok/frame' AS about FROM priced"
)
def shape_pricing(t):
    """What a page costs each reader, and the line that describes its shape."""
    return shaped(t).select("c_custkey", shapes.frame_tokens(F.col("family"), F.col("frame_size")).alias("tokens"), shapes.describe(F.col("family")).alias("about"))


@query(
    f"WITH {SHAPED}, d AS (SELECT *, (frame_size // 8) * ((frame_size - 16) // 16) AS other FROM grid) "
    "SELECT c_custkey, variant, CASE WHEN columns = 1 AND font <> 'silver' AND other > capacity THEN '8on16-bw' ELSE variant END AS dense_variant FROM d"
)
def dense_companion(t):
    """The denser shape for the middle of each reader's archives."""
    return shapes.with_dense(shaped(t)).select("c_custkey", "variant", "dense_variant")


# --- Cells, pages, plans ------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(length(coalesce(text, '')) + 5 AS BIGINT) AS wide, CAST(length(coalesce(text, '')) + 4 AS BIGINT) AS narrow FROM documents")
def cell_length(t):
    body = F.concat(F.lit("a\u000eb日c"), F.coalesce("text", F.lit("")))
    return t("documents").select("doc_id", cells.cell_length(body).cast("long").alias("wide"), cells.cell_length(body, False).cast("long").alias("narrow"))


@query(f"WITH {NORMAL} SELECT conv_id, i AS page_no, substring(text, CAST(i * {HIGH} + 1 AS BIGINT), {HIGH}) AS text FROM (SELECT conv_id, text, unnest(range(CAST(ceil(length(text) / {HIGH}) AS BIGINT))) AS i FROM normal)")
def paginate(t):
    paged = normal(t).select("conv_id", F.posexplode(cells.narrow_pages(F.col("text"), F.lit(HIGH))).alias("page_no", "text"))
    return paged.withColumn("page_no", F.col("page_no").cast("long"))


@query(
    f"WITH {NORMAL}, a AS (SELECT conv_id, text FROM normal), b AS (SELECT conv_id, i AS page_no, substring(text, CAST(i * 50 + 1 AS BIGINT), 50) AS text FROM (SELECT conv_id, text, unnest(range(CAST(ceil(length(text) / 50) AS BIGINT))) AS i FROM a)) SELECT conv_id, page_no, text FROM b"
)
def paginate_any_width(t):
    """The fold for texts of any width, here over texts of one-cell characters, where it equals the substring form."""
    paged = normal(t).select("conv_id", cells.pages_udf()("text", F.lit(50), F.lit(10)).alias("pages")).select("conv_id", F.posexplode("pages").alias("page_no", "text"))
    return paged.withColumn("page_no", F.col("page_no").cast("long"))


WRAPPED = (
    NORMAL
    + """, w AS (SELECT conv_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM normal),
l AS (SELECT conv_id, list_reduce(list_transform(w, lambda x: [x]), lambda acc, x: CASE WHEN length(acc[len(acc)]) + 1 + length(x[1]) <= 200 THEN list_concat(acc[:len(acc) - 1], [acc[len(acc)] || ' ' || x[1]]) ELSE list_concat(acc, x) END) AS lines FROM w WHERE len(w) > 0),
r AS (SELECT conv_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM l)"""
)


@query(f"WITH {WRAPPED} SELECT conv_id, CAST(n AS BIGINT) AS line_no, line AS text FROM r")
def wrap_text(t):
    lines = normal(t).select("conv_id", cells.lines_udf(200, False)("text").alias("lines"))
    return lines.select("conv_id", F.posexplode("lines").alias("i", "text")).select("conv_id", (F.col("i") + 1).cast("long").alias("line_no"), "text")


@query(
    f"WITH {WRAPPED} SELECT conv_id, CAST((n - 1) // 2 AS BIGINT) AS page_no, string_agg(line, chr(10) ORDER BY n) AS text FROM r GROUP BY conv_id, (n - 1) // 2"
)
def doc_pages(t):
    lines = normal(t).select("conv_id", cells.lines_udf(200, False)("text").alias("lines"))
    paged = lines.select("conv_id", F.posexplode(cells.doc_pages(F.col("lines"), 1)).alias("page_no", "text"))
    return paged.withColumn("page_no", F.col("page_no").cast("long"))


EDGES = NORMAL + f", e AS (SELECT conv_id, length(text) AS n_chars, CASE WHEN length(text) <= {2 * HIGH} THEN text ELSE left(text, {HIGH}) END AS head, CASE WHEN length(text) <= {2 * HIGH} THEN '' ELSE right(text, {HIGH}) END AS tail, CASE WHEN length(text) <= {2 * HIGH} THEN '' ELSE substring(text, {HIGH + 1}, length(text) - {2 * HIGH}) END AS middle FROM normal)"
PLAN = (
    EDGES
    + f""", p AS (SELECT *, CAST(ceil(length(middle) / {HIGH}) AS BIGINT) AS fine FROM e),
o AS (SELECT *, fine > {{most}} AS over, least(3, greatest(0, ({{most}} - 1) // 2)) AS edge FROM p),
m AS (SELECT *, CASE WHEN over THEN substring(middle, edge * {HIGH} + 1, greatest(0, length(middle) - edge * {HIGH} - (length(middle) - (fine - edge) * {HIGH}))) ELSE '' END AS inner_text FROM o),
k AS (SELECT *, CAST(ceil(length(inner_text) / {LOW}) AS BIGINT) AS dense FROM m),
t AS (SELECT *, CASE WHEN over THEN greatest(0, dense - ({{most}} - 2 * edge)) ELSE 0 END AS gone FROM k)"""
)


@query(f"WITH {EDGES} SELECT conv_id, CAST(n_chars AS INTEGER) AS n_chars, head, tail, middle FROM e")
def head_tail_split(t):
    head, tail, middle = layout.edges(F.col("text"), HIGH)
    return normal(t).select("conv_id", F.length("text").alias("n_chars"), head.alias("head"), tail.alias("tail"), middle.alias("middle"))


def planned(t, most: int) -> DataFrame:
    return layout.plan(normal(t), HIGH, LOW, most)


def plan_summary(plans: DataFrame) -> DataFrame:
    return plans.select("conv_id", "n_chars", "head", "tail", F.size("pages").cast("long").alias("n_pages"), "truncated")


PLANNED = "SELECT conv_id, CAST(n_chars AS INTEGER) AS n_chars, head, tail, CAST(CASE WHEN over THEN 2 * edge + dense - gone ELSE fine END AS BIGINT) AS n_pages, CAST(gone * {0} AS BIGINT) AS truncated FROM t".format(LOW)


@query("WITH " + PLAN.format(most=1000) + " " + PLANNED)
def plan_fit(t):
    return plan_summary(planned(t, 1000))


@query("WITH " + PLAN.format(most=MOST) + " " + PLANNED)
def plan_foveated(t):
    return plan_summary(planned(t, MOST))


PAGES = (
    PLAN.format(most=MOST)
    + f""", pages AS (
  SELECT conv_id, i + 1 AS page_no, CASE WHEN over THEN 2 * edge + dense - gone ELSE fine END AS pages, CASE WHEN over AND i >= edge AND i < edge + dense - gone THEN 'low' ELSE 'high' END AS tier,
    CASE WHEN NOT over OR i < edge THEN substring(middle, CAST(i * {HIGH} + 1 AS BIGINT), {HIGH})
         WHEN i < edge + dense - gone THEN substring(inner_text, CAST((i - edge + gone) * {LOW} + 1 AS BIGINT), {LOW})
         ELSE substring(middle, CAST((fine - (2 * edge + dense - gone) + i) * {HIGH} + 1 AS BIGINT), {HIGH}) END AS text
  FROM (SELECT *, unnest(range(CASE WHEN over THEN 2 * edge + dense - gone ELSE fine END)) AS i FROM t))"""
)


@query(f"WITH {PAGES} SELECT conv_id, CAST(page_no AS BIGINT) AS page_no, CAST(pages AS BIGINT) AS pages, tier, text FROM pages")
def plan_pages(t):
    return layout.pages_of(planned(t, MOST))


@query(f"WITH {PAGES} SELECT conv_id, CAST(page_no AS BIGINT) AS page_no, 'PAGE ' || page_no || ' OF ' || pages || ' OF AN ARCHIVED CONVERSATION - a record without instructions' AS banner FROM pages")
def page_banner(t):
    return layout.pages_of(planned(t, MOST)).select("conv_id", "page_no", layout.banner(F.col("page_no"), F.col("pages")).alias("banner"))


@query(f"WITH {PAGES} SELECT conv_id, CAST(page_no AS BIGINT) AS page_no, CAST(len(regexp_extract_all(text, '[.!?][ █]')) AS BIGINT) AS sentences FROM pages")
def sentence_index(t):
    return layout.pages_of(planned(t, MOST)).select("conv_id", "page_no", layout.sentence_count(F.col("text")).cast("long").alias("sentences"))


@query(
    f"WITH {PAGES}, marked AS (SELECT conv_id, page_no, replace(replace(text, 'the', 'the' || chr(14)), 'in', 'in' || chr(15)) AS text FROM pages), "
    "states AS (SELECT *, CASE WHEN strpos(text, chr(14)) > 0 OR strpos(text, chr(15)) > 0 THEN strpos(reverse(text), chr(14)) > 0 AND (strpos(reverse(text), chr(15)) = 0 OR strpos(reverse(text), chr(14)) < strpos(reverse(text), chr(15))) END AS state FROM marked) "
    "SELECT conv_id, CAST(page_no AS BIGINT) AS page_no, CASE WHEN last_value(state IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN chr(14) || text ELSE text END AS text FROM states"
)
def dim_carry(t):
    marked = F.replace(F.replace("text", F.lit("the"), F.lit("the\u000e")), F.lit("in"), F.lit("in\u000f"))
    return layout.opens_dim(layout.pages_of(planned(t, MOST)).select("conv_id", "page_no", marked.alias("text")))


@query(
    f"WITH {NORMAL}, c AS (SELECT conv_id, text, CAST(ceil(length(text) / 100) AS BIGINT) AS n FROM normal), "
    "q AS (SELECT *, list_transform(range(n), lambda i: substring(text, CAST(i * 100 + 1 AS BIGINT), 100)) AS pages FROM c) "
    "SELECT conv_id, least(n, 9) AS n_pages, array_to_string(CASE WHEN n > 9 THEN list_concat(pages[1:1], pages[n - 7:]) ELSE pages END, ' ') AS kept, CASE WHEN n > 9 THEN (n - 9) * 100 ELSE 0 END AS truncated FROM q"
)
def plan_doc(t):
    paged = normal(t).select("conv_id", cells.narrow_pages(F.col("text"), F.lit(100)).alias("pages"))
    return layout.plan_two_columns(paged, 9)


#: Two thirds of the conversations with ideographs for some letters, half of these with ink marks too; grids of odd widths, so that wide characters meet the last column.
MADE_WIDE = "CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN translate(text, 'ae', '界語') ELSE replace(replace(translate(text, 'ae', '界語'), 'n', chr(14) || 'n'), 't', chr(15) || 't') END"
FINE, DENSE = (17, 9), (21, 10)


def page_starts(text: str, grid: tuple[int, int]) -> str:
    """SQL of the places where pages of ``grid`` cells start: a fold over the characters."""
    cols, cap = grid[0], grid[0] * grid[1]
    none = "CAST([] AS BIGINT[])"
    state = lambda i, cursor, starts: f"{{'i': CAST({i} AS BIGINT), 'cursor': CAST({cursor} AS BIGINT), 'starts': {starts}}}"
    width = "CASE WHEN c = '' OR c = chr(14) OR c = chr(15) THEN 0 WHEN c = '界' OR c = '語' THEN 2 ELSE 1 END"
    pad = f"CASE WHEN x.i = 2 AND a.cursor % {cols} = {cols - 1} THEN 1 ELSE 0 END"
    return (
        f"list_reduce(list_prepend({state(0, 0, none)}, list_transform(string_split({text}, ''), lambda c: {state(width, 0, none)})), lambda a, x: "
        f"CASE WHEN x.i = 0 THEN {state('a.i + 1', 'a.cursor', 'a.starts')} WHEN a.cursor = 0 THEN {state('a.i + 1', 'x.i', '[CAST(1 AS BIGINT)]')} "
        f"WHEN a.cursor + {pad} + x.i > {cap} THEN {state('a.i + 1', 'x.i', 'list_append(a.starts, a.i + 1)')} ELSE {state('a.i + 1', f'a.cursor + {pad} + x.i', 'a.starts')} END).starts"
    )


def wide_plan(normal: str, most: int) -> str:
    """SQL that plans ``normal`` (conv_id, text) by cells: t with head, tail, fine, dense, gone and pages."""
    cap, edge = FINE[0] * FINE[1], min(layout.EDGE_PAGES, max(0, (most - 1) // 2))
    cut = lambda text, starts: f"list_transform(range(1, len({starts}) + 1), lambda i: substring({text}, {starts}[i], coalesce({starts}[i + 1], length({text}) + 1) - {starts}[i]))"
    tier = lambda pages, name: f"list_transform({pages}, lambda p: {{'tier': '{name}', 'text': p}})"
    return f"""normal AS ({normal}),
e AS (SELECT *, length(text) AS n_chars, CASE WHEN length(text) <= {2 * cap} THEN text ELSE left(text, {cap}) END AS head, CASE WHEN length(text) <= {2 * cap} THEN '' ELSE right(text, {cap}) END AS tail, CASE WHEN length(text) <= {2 * cap} THEN '' ELSE substring(text, {cap + 1}, length(text) - {2 * cap}) END AS middle FROM normal),
f AS (SELECT *, {page_starts('middle', FINE)} AS fs FROM e),
o AS (SELECT *, {cut('middle', 'fs')} AS hi, len(fs) AS fine, len(fs) > {most} AS over FROM f),
m AS (SELECT *, CASE WHEN over THEN substring(middle, fs[{edge + 1}], fs[fine - {edge} + 1] - fs[{edge + 1}]) ELSE '' END AS inner_text FROM o),
k AS (SELECT *, {page_starts('inner_text', DENSE)} AS ds FROM m),
l AS (SELECT *, {cut('inner_text', 'ds')} AS lo, len(ds) AS dense, CASE WHEN over THEN greatest(0, len(ds) - {most - 2 * edge}) ELSE 0 END AS gone FROM k),
t AS (SELECT *, CASE WHEN gone > 0 THEN coalesce(ds[gone + 1] - 1, length(inner_text)) ELSE 0 END AS dropped,
  CASE WHEN over THEN list_concat(list_concat({tier(f'hi[1:{edge}]', 'high')}, {tier('lo[gone + 1:]', 'low')}), {tier(f'hi[fine - {edge} + 1:]', 'high')}) ELSE {tier('hi', 'high')} END AS pages FROM l)"""


def made_wide(text: Column) -> Column:
    wide = F.translate(text, "ae", "界語")
    marked = F.replace(F.replace(wide, F.lit("n"), F.lit(T.DIM_ON + "n")), F.lit("t"), F.lit(T.DIM_OFF + "t"))
    return F.when(F.col("conv_id") % 3 == 0, text).when(F.col("conv_id") % 3 == 1, wide).otherwise(marked)


@query(
    f"WITH {NORMAL.replace('normal AS', 'latin AS')}, {wide_plan(f'SELECT conv_id, {MADE_WIDE} AS text FROM latin', MOST)} "
    "SELECT conv_id, CAST(i AS BIGINT) AS page_no, CAST(len(pages) AS BIGINT) AS pages, pages[i].tier AS tier, pages[i].text AS text, CAST(dropped AS BIGINT) AS truncated FROM (SELECT *, unnest(range(1, len(pages) + 1)) AS i FROM t)"
)
def plan_any_width(t):
    """Pages of both tiers over texts with ideographs and ink marks."""
    texts = normal(t).select("conv_id", made_wide(F.col("text")).alias("text"))
    plans = layout.plan(texts, FINE[0] * FINE[1], DENSE[0] * DENSE[1], MOST, (FINE[0], DENSE[0]))
    rows = plans.select("conv_id", "truncated", F.size("pages").cast("long").alias("n"), F.posexplode("pages").alias("i", "p"))
    return rows.select("conv_id", (F.col("i") + 1).cast("long").alias("page_no"), F.col("n").alias("pages"), "p.tier", "p.text", "truncated")


# --- Archives ------------------------------------------------------------------------------------------------

DIRS = "'archive-frames-' || CASE doc_id % 4 WHEN 0 THEN '../x' WHEN 1 THEN '' ELSE CAST(doc_id AS VARCHAR) END"
ARCHIVES = f"""archives AS (
  SELECT doc_id AS conv_id, {DIRS} AS frames_dir, CASE WHEN doc_id % 5 > 0 THEN coalesce(text, '') ELSE '' END AS text, n_chars AS total_chars,
         CASE doc_id % 3 WHEN 0 THEN sha256(coalesce(text, '')) WHEN 1 THEN 'broken' END AS mac, CASE WHEN doc_id % 2 = 0 THEN sha256(coalesce(text, '')) || '.png' ELSE '../etc' END AS file, doc_id % 7 > 0 AS is_png
  FROM documents)"""


def archives(t) -> DataFrame:
    body, n = F.coalesce("text", F.lit("")), F.col("doc_id")
    frame = F.struct(
        F.lit("").alias("data"), F.when(n % 2 == 0, archive.file_name(body.cast("binary"))).otherwise("../etc").alias("file"), F.when(n % 7 > 0, "image/png").otherwise("text/html").alias("mime_type"),
        F.lit(10).alias("cols"), F.lit(10).alias("rows"), F.length(body).alias("chars"),
    )
    tail = F.when(n % 4 == 0, "../x").when(n % 4 == 1, "").otherwise(n.cast("string"))
    return t("documents").select(
        n.alias("conv_id"), F.lit("").alias("lead_in"), F.concat(F.lit("archive-frames-"), tail).alias("frames_dir"), F.array(frame).alias("frames"), F.col("n_chars").alias("total_chars"), F.lit(None).cast("long").alias("truncated_chars"),
        F.when(n % 5 > 0, body).otherwise("").alias("text"), F.lit("").alias("text_head"), F.lit("").alias("text_tail"), F.when(n % 3 == 0, F.sha2(body, 256)).when(n % 3 == 1, "broken").alias("mac"),
    )


@query(
    f"WITH {ARCHIVES} SELECT conv_id, CASE WHEN regexp_full_match(frames_dir, 'archive-frames-[0-9]{{1,16}}') THEN frames_dir END AS frames_dir, CAST(CASE WHEN regexp_full_match(file, '[0-9a-f]{{64}}\\.png') AND is_png THEN 1 ELSE 0 END AS INTEGER) AS n_frames, "
    "nullif(text, '') AS text, coalesce(total_chars, 0) AS total_chars, CASE WHEN length(mac) = 64 THEN mac END AS mac FROM archives WHERE text <> '' OR (regexp_full_match(file, '[0-9a-f]{64}\\.png') AND is_png)"
)
def archive_validate(t):
    return archive.validate(archives(t)).select("conv_id", "frames_dir", F.size("frames").alias("n_frames"), "text", "total_chars", "mac")


@query(
    f"WITH {ARCHIVES} SELECT conv_id, regexp_full_match(frames_dir, 'archive-frames-[0-9]{{1,16}}') AS dir_ok, regexp_full_match(file, '[0-9a-f]{{64}}\\.png') AS file_ok, file = sha256(text) || '.png' AS matches FROM archives"
)
def frame_names(t):
    file = F.col("frames")[0]["file"]
    return archives(t).select("conv_id", archive.is_dir_name(F.col("frames_dir")).alias("dir_ok"), archive.is_file_name(file).alias("file_ok"), (file == archive.file_name(F.col("text").cast("binary"))).alias("matches"))


PADS = tuple("".join(f"{b ^ pad:02x}" for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))
HMAC = f"sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode({{0}}))))"
CANONICAL = "'{\"conv_id\":' || conv_id || ',\"total_chars\":' || n || '}'"
SIGNED = f"small AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), signed AS (SELECT conv_id, n AS total_chars, {HMAC.format(CANONICAL)} AS mac FROM small)"


def small_archives(t) -> DataFrame:
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("total_chars"))


@query(f"WITH {SIGNED} SELECT * FROM signed")
def archive_sign(t):
    return archive.sign(small_archives(t), KEY)


@query(f"WITH {SIGNED} SELECT conv_id, conv_id % 3 <> 0 AS trusted FROM signed")
def archive_verify(t):
    signed = archive.sign(small_archives(t), KEY)
    tampered = signed.withColumn("total_chars", F.when(F.col("conv_id") % 3 == 0, F.col("total_chars") + 1).otherwise(F.col("total_chars")))
    return tampered.select("conv_id", archive.verified(tampered, KEY).alias("trusted"))


@query("SELECT user_id AS conv_id, max(event_id) FILTER (WHERE ts = latest) AS seq, max(latest) AS ts FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS latest FROM events) GROUP BY user_id")
def latest_archive(t):
    written = t("events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("seq"), "ts")
    return archive.latest(written).select("conv_id", "seq", "ts")


BUDGET = 12_000
SLOTS = f"""frames AS (SELECT conv_id, turn AS pos, CAST(length(text) * 4 AS BIGINT) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations),
slots AS (
  WITH RECURSIVE f(conv_id, k, used, kept) AS (
    SELECT conv_id, 1, CASE WHEN bytes <= {BUDGET} THEN bytes ELSE 0 END, bytes <= {BUDGET} FROM frames WHERE k = 1
    UNION ALL
    SELECT f.conv_id, f.k + 1, CASE WHEN f.used + x.bytes <= {BUDGET} THEN f.used + x.bytes ELSE f.used END, f.used + x.bytes <= {BUDGET} FROM f JOIN frames x ON x.conv_id = f.conv_id AND x.k = f.k + 1
  ) SELECT x.conv_id, x.pos, f.kept, x.bytes FROM f JOIN frames x USING (conv_id, k)
)"""


def slots(t) -> DataFrame:
    sized = t("conversations").select("conv_id", F.struct(F.col("turn").alias("pos"), (F.length("text").cast("long") * 4).alias("bytes")).alias("f"))
    gathered = sized.groupBy("conv_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    kept = archive.within_budget(F.transform("fs", lambda f: f["bytes"]), BUDGET)
    zipped = F.explode(F.zip_with("fs", kept, lambda f, k: F.struct(f["pos"].alias("pos"), k.alias("kept"), f["bytes"].alias("bytes"))))
    return gathered.select("conv_id", zipped.alias("s")).select("conv_id", "s.*")


@query(f"WITH {SLOTS} SELECT conv_id, pos, kept, bytes FROM slots")
def frame_budget(t):
    return slots(t)


@query(f"WITH {SLOTS}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM slots WHERE NOT kept) SELECT conv_id, min(pos) AS first, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM g GROUP BY conv_id, run")
def gap_runs(t):
    return archive.gap_runs(slots(t))


NOTE = "'-------------- pages left out here' || chr(10) || n || ' page' || CASE n WHEN 1 THEN '' ELSE 's' END || ' of the archive (' || " + SIZE.format("size") + " || ' of base64) did not fit this request; the text around the pages and the others are here.' || chr(10) || '--------------'"


@query(
    "WITH a AS (SELECT doc_id AS conv_id, 'a' || coalesce(text, '') AS data, length('a' || coalesce(text, '')) AS n0 FROM documents), b AS (SELECT *, n0 <= 3000 AS kept, 1 AS n, CAST(n0 AS BIGINT) AS size FROM a), "
    f"c AS (SELECT conv_id, 0 AS pos, 'text' AS type, CASE WHEN kept THEN '<archived-history>' || chr(10) || 'head' || chr(10) || '-------------- pages follow' || chr(10) ELSE '<archived-history>' || chr(10) || 'head' END AS text, NULL AS data FROM b "
    f"UNION ALL SELECT conv_id, 1, CASE WHEN kept THEN 'image' ELSE 'text' END, CASE WHEN NOT kept THEN {NOTE} || chr(10) || '-------------- pages left out above' || chr(10) || 'tail' || chr(10) || '</archived-history>' END, CASE WHEN kept THEN data END FROM b "
    "UNION ALL SELECT conv_id, 2, 'text', '-------------- pages end' || chr(10) || 'tail' || chr(10) || '</archived-history>', NULL FROM b WHERE kept) SELECT conv_id, CAST(pos AS BIGINT) AS pos, type, text, data FROM c"
)
def rebuild_blocks(t):
    data = F.concat(F.lit("a"), F.coalesce("text", F.lit("")))
    made = t("documents").select(F.col("doc_id").alias("conv_id"), F.array(F.struct(data.alias("data"))).alias("frames"), F.lit("head").alias("text_head"), F.lit("tail").alias("text_tail"), F.lit(0).alias("truncated_chars"))
    return archive.blocks(made, 3000)


ASKED_BYTES, ESTIMATE = 24_000, 9_000
MIXED = f"""fr AS (
  SELECT doc_id // 12 AS conv_id, doc_id % 12 AS pos, doc_id * 7 % 12 AS kind, to_base64(encode(coalesce(text, '') || 'a')) AS file_data, coalesce(text, '') || 'a' AS own_data, row_number() OVER (PARTITION BY doc_id // 12 ORDER BY doc_id DESC) AS k FROM documents),
cost AS (SELECT *, CASE WHEN kind < 4 THEN length(own_data) ELSE {ESTIMATE} END AS cost, CASE WHEN kind < 4 THEN own_data WHEN kind < 9 THEN file_data END AS data FROM fr),
slots AS (
  WITH RECURSIVE f(conv_id, k, used, state) AS (
    SELECT conv_id, 1, CASE WHEN cost > {ASKED_BYTES} THEN 0 ELSE coalesce(length(data), 0) END, CASE WHEN cost > {ASKED_BYTES} THEN 'omitted' WHEN data IS NULL THEN 'unavailable' ELSE 'kept' END FROM cost WHERE k = 1
    UNION ALL
    SELECT f.conv_id, f.k + 1, CASE WHEN f.used + x.cost > {ASKED_BYTES} THEN f.used ELSE f.used + coalesce(length(x.data), 0) END, CASE WHEN f.used + x.cost > {ASKED_BYTES} THEN 'omitted' WHEN x.data IS NULL THEN 'unavailable' ELSE 'kept' END FROM f JOIN cost x ON x.conv_id = f.conv_id AND x.k = f.k + 1
  ) SELECT x.conv_id, x.pos, f.state, x.cost, x.data FROM f JOIN cost x USING (conv_id, k)
)"""
SLOT_BYTES = "CASE state WHEN 'omitted' THEN cost WHEN 'kept' THEN length(data) ELSE 0 END"


def mixed_archives(t) -> DataFrame:
    """A dozen documents as the frames of an archive: some hold their data, some refer to files, some of which are not there. The files are written.

    A file that is not there has the name of bytes that no text has, so that an equal text of the archive is not taken for it.
    """
    n, body = F.col("doc_id"), F.concat(F.coalesce("text", F.lit("")), F.lit("a"))
    docs = t("documents").select(F.floor(n / 12).alias("conv_id"), (n % 12).alias("pos"), (n * 7 % 12).alias("kind"), body.alias("body"), F.concat(F.lit(archive.DIR_PREFIX), F.floor(n / 12).cast("string")).alias("frames_dir"))
    root = scratch(docs.sparkSession, "mixed")
    stored = docs.where("kind between 4 and 8").select("frames_dir", F.col("body").cast("binary").alias("png"))
    frame_store.save(stored, root)
    png = F.col("body").cast("binary")
    named = F.when(F.col("kind") >= 9, F.concat(F.lit(b"\xff"), png)).when(F.col("kind") >= 4, png)
    frame = F.struct("pos", F.when(F.col("kind") < 4, F.col("body")).alias("data"), archive.file_name(named).alias("file"))
    gathered = docs.groupBy("conv_id", "frames_dir").agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    archives = gathered.select("conv_id", "frames_dir", "frames", F.lit("head").alias("text_head"), F.lit("tail").alias("text_tail"), F.lit(0).alias("truncated_chars"))
    return frame_files_of.with_slots(archives, root, ASKED_BYTES, ESTIMATE)


@query(f"WITH {MIXED} SELECT conv_id, pos, state, CAST({SLOT_BYTES} AS BIGINT) AS bytes, CASE WHEN state = 'kept' THEN sha256(data) END AS sha FROM slots")
def frame_slots(t):
    """Admission by an estimate, with actual sizes of the files that were opened."""
    rows = mixed_archives(t).select("conv_id", F.explode(F.zip_with("frames", "slots", lambda f, s: F.struct(f["pos"].alias("pos"), s.alias("s")))).alias("x"))
    return rows.select("conv_id", "x.pos", "x.s.state", "x.s.bytes", F.sha2(F.col("x.s.data").cast("binary"), 256).alias("sha"))


GONE_NOTE = "'-------------- pages left out here' || chr(10) || n || ' page' || CASE n WHEN 1 THEN '' ELSE 's' END || ' of the archive (' || " + SIZE.format("size") + " || ' of base64) did not fit this request; the text around the pages and the others are here.' || chr(10) || '--------------'"


@query(
    f"""WITH {MIXED},
g AS (SELECT *, coalesce(sum(CASE WHEN state = 'kept' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM slots),
r AS (SELECT conv_id, grp, count(*) FILTER (WHERE state = 'unavailable') AS u, count(*) FILTER (WHERE state = 'omitted') AS n, CAST(coalesce(sum(cost) FILTER (WHERE state = 'omitted'), 0) AS BIGINT) AS size, max(data) FILTER (WHERE state = 'kept') AS data,
  coalesce(arg_max(state, pos) FILTER (WHERE state <> 'kept') = 'unavailable', false) AS ends_missing, bool_or(state = 'kept') AS shown FROM g GROUP BY conv_id, grp),
body AS (
  SELECT conv_id, grp, 1 AS part, 'text' AS type, '-------------- one page of the archive is missing here (no file) --------------' AS text, NULL AS data FROM (SELECT *, unnest(range(u - CASE WHEN ends_missing AND shown THEN 1 ELSE 0 END)) AS i FROM r)
  UNION ALL SELECT conv_id, grp, 2, 'text', {GONE_NOTE}, NULL FROM r WHERE n > 0
  UNION ALL SELECT conv_id, grp, 3, 'text', '-------------- one page of the archive is missing here (no file) --------------', NULL FROM r WHERE ends_missing AND shown
  UNION ALL SELECT conv_id, grp, 4, 'image', NULL, data FROM r WHERE shown),
pics AS (SELECT conv_id, bool_or(shown) AS images, bool_or(u + n > 0) AS gaps FROM r GROUP BY conv_id),
listed AS (
  SELECT conv_id, -1 AS grp, 0 AS part, 'text' AS type, '<archived-history>' || chr(10) || 'head' || CASE WHEN images THEN chr(10) || '-------------- pages follow' || chr(10) ELSE '' END AS text, NULL AS data FROM pics
  UNION ALL SELECT * FROM body),
lined AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY grp, part) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) - 1 AS final FROM listed),
ends AS (SELECT conv_id, CASE WHEN images THEN '-------------- pages end' || chr(10) WHEN gaps THEN chr(10) || '-------------- pages left out above' || chr(10) ELSE '' END || 'tail' || chr(10) || '</archived-history>' AS ending FROM pics)
SELECT conv_id, CAST(pos AS BIGINT) AS pos, type, text || CASE WHEN pos = final THEN ending ELSE '' END AS text, sha256(data) AS sha FROM lined JOIN ends USING (conv_id)
UNION ALL SELECT conv_id, CAST(pos + 1 AS BIGINT), 'text', ending, NULL FROM lined JOIN ends USING (conv_id) WHERE pos = final AND type = 'image'"""
)
def rebuild_mixed(t):
    """Blocks of archives whose frames are partly kept, partly too large and partly without their file."""
    made = archive.blocks(mixed_archives(t), ASKED_BYTES)
    return made.select("conv_id", "pos", "type", "text", F.sha2(F.col("data").cast("binary"), 256).alias("sha"))


def made_fonts(t) -> DataFrame:
    """Glyphs of two fonts, written as hex files from the characters of the documents and parsed: one of every third code point, one of every seventh behind it."""
    from foliant.sources import fonts

    chars = t("documents").select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), ""))).alias("ch")).where("ch <> ''").select(F.ascii("ch").alias("cp")).distinct()
    spark, root, made = chars.sparkSession, shared(chars.sparkSession, "fonts"), None
    for font, every in (("own", 3), ("behind", 7)):
        chars.where(F.col("cp") % every == 0).select(F.format_string("%04X:%016X", F.col("cp"), F.col("cp").cast("long"))).write.text(f"{root}/{font}")
        glyphs = fonts.read_hex(spark, f"{root}/{font}", font)
        made = glyphs if made is None else made.unionByName(glyphs)
    return fonts.with_fallback(fonts.coverage(made), "own", "behind")


CHARACTERS = "SELECT unnest(string_split(coalesce(text, ''), '')) AS ch FROM documents"


@query(f"SELECT DISTINCT ch, unicode(ch) % 3 = 0 OR unicode(ch) % 7 = 0 AS printable FROM ({CHARACTERS}) WHERE ch <> ''")
def font_coverage(t):
    """Distinct characters of the documents against bitmaps of two parsed fonts, the second behind the first."""
    from foliant.sources import fonts

    chars = t("documents").select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), ""))).alias("ch")).where("ch <> ''").distinct()
    return fonts.printable(chars, made_fonts(t))


@query(
    f"SELECT d.doc_id, CAST(count(ch) FILTER (WHERE ch <> '' AND ch <> ' ') AS BIGINT) AS visible, CAST(count(ch) FILTER (WHERE ch <> '' AND ch <> ' ' AND unicode(ch) % 3 > 0 AND unicode(ch) % 7 > 0) AS BIGINT) AS lost FROM documents d LEFT JOIN ({CHARACTERS.replace('SELECT', 'SELECT doc_id,')}) c USING (doc_id) GROUP BY d.doc_id"
)
def font_losses(t):
    """What of each document no font prints."""
    from foliant.sources import fonts

    return fonts.text_stats(t("documents").select("doc_id", "text"), made_fonts(t)).drop("text")


ARGS_TEXT = "'{\"z\": \"say \\\"' || event_type || '\\\"\", \"a\" : {\"y\": 1, \"b\": [true, null, \"x\"]}, \"num\":\"7\", \"none\": null, \"props\": ' || coalesce(props, '0') || ', \"long\": \"' || repeat(event_type, 200) || '\"}'"
LONG_ARG = "'\"' || repeat(event_type, 200) || '\"'"
ARG_LINE = f"""'z="say \\"' || event_type || '\\"", a={{"y":1,"b":[true,null,"x"]}}, num="7", none=null, props=' || replace(coalesce(props, '0'), ': ', ':') || ', long=' || left({LONG_ARG}, 300) || ' […' || (length({LONG_ARG}) - 500) || 'ch elided…] ' || right({LONG_ARG}, 200)"""


@query(f"SELECT event_id, 'look(' || {ARG_LINE} || ')' AS text FROM events")
def call_arguments(t):
    """Nested arguments in the order they were given, each cut to its cap."""
    said = F.concat(
        F.lit('{"z": "say \\"'), "event_type", F.lit('\\"", "a" : {"y": 1, "b": [true, null, "x"]}, "num":"7", "none": null, "props": '), F.coalesce("props", F.lit("0")), F.lit(', "long": "'), F.repeat("event_type", F.lit(200)), F.lit('"}')
    )
    args = spread(t("events").select("event_id", "event_type", "props")).select("event_id", said.alias("said")).withColumn("args", transcript.arguments(F.col("said")))
    return args.select("event_id", transcript.call_line(F.lit("look"), F.col("args")).alias("text"))


TREE = """tree AS (
  SELECT conv_id, id, CASE WHEN k > 4 AND id % 3 = 1 THEN lag(id, 2) OVER w WHEN k > 4 AND id % 3 = 2 THEN lag(id, 3) OVER w ELSE lag(id) OVER w END AS parent_id, id % 9 = 0 AS stops FROM (
    SELECT user_id AS conv_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
leaves AS (SELECT conv_id, id AS leaf FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS back FROM tree) WHERE back <= 5)"""


@query(
    f"""WITH RECURSIVE {TREE},
walk AS (
  SELECT l.conv_id, l.leaf, t.id, t.parent_id, t.stops FROM leaves l JOIN tree t ON t.conv_id = l.conv_id AND t.id = l.leaf
  UNION ALL
  SELECT w.conv_id, w.leaf, t.id, t.parent_id, t.stops FROM walk w JOIN tree t ON t.conv_id = w.conv_id AND t.id = w.parent_id WHERE NOT w.stops)
SELECT l.conv_id, l.leaf, w.id, w.id % 5 > 0 AS trusted, CASE WHEN w.id % 5 > 0 THEN w.id END AS total_chars, 'archive-frames-' || w.id AS frames_dir FROM leaves l LEFT JOIN (SELECT * FROM walk WHERE stops) w USING (conv_id, leaf)"""
)
def branch_archive(t):
    """The first compaction above the last five entries of each conversation, in trees made of the events; every fifth archive was changed after signing."""
    from foliant.operators import branches

    events = t("events")
    by = Window.partitionBy("conv_id").orderBy("id")
    entries = events.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("id"), "event_type")
    k = F.row_number().over(by)
    parent = F.when((k > 4) & (F.col("id") % 3 == 1), F.lag("id", 2).over(by)).when((k > 4) & (F.col("id") % 3 == 2), F.lag("id", 3).over(by)).otherwise(F.lag("id").over(by))
    tree = entries.withColumns({"parent_id": parent, "type": F.when(F.col("id") % 9 == 0, "compaction").otherwise("message")})
    leaves = tree.withColumn("back", F.row_number().over(by.orderBy(F.col("id").desc()))).where("back <= 5").select("conv_id", F.col("id").alias("leaf"))
    n = F.col("id")
    made = tree.select(
        "conv_id", "id", "parent_id", "type", F.lit("lead").alias("lead_in"), F.concat(F.lit(archive.DIR_PREFIX), n.cast("string")).alias("frames_dir"), F.array().cast(f"array<{writing.FRAME}>").alias("frames"),
        n.alias("total_chars"), F.lit(0).cast("long").alias("truncated_chars"), F.col("event_type").alias("text"), F.lit("").alias("text_head"), F.lit("").alias("text_tail"), F.lit("").alias("mac"),
    )
    valid = archive.validate(made)
    signed = valid.withColumn("mac", archive.hmac_sha256(archive.canonical(valid.drop("id", "parent_id", "type")), KEY)).withColumn("total_chars", F.when(n % 5 == 0, n + 1).otherwise(F.col("total_chars")))
    return branches.previous_archives(signed, leaves, KEY).select("conv_id", "leaf", "id", "trusted", "total_chars", "frames_dir")


@query(
    """SELECT c_custkey, k % 5 <> 0 AS enabled, CASE WHEN k % 5 = 1 OR k % 7 = 0 THEN 'auto' ELSE 'doc-8on16-bw' END AS shape,
CASE WHEN k % 5 = 0 THEN 7 WHEN k % 5 = 1 THEN NULL WHEN k - 3 > 0 THEN least(k - 3, 80) END AS max_frames
FROM (SELECT c_custkey, c_custkey % 100 AS k FROM customer)"""
)
def settings_overlay(t):
    """Two layers of settings a customer, as JSON: the nearer one wins, values of a wrong type are ignored, counts are bounded; every fifth near layer is broken, one is no object."""
    from foliant import options

    k = F.col("c_custkey") % 100
    far = F.format_string('{"shape": "%s", "max_frames": %d, "enabled": true}', F.when(k % 7 == 0, "unknown").otherwise("doc-8on16-bw"), k - 3)
    near = F.when(k % 5 == 0, '{"max_frames": 7.9, "enabled": false}').when(k % 5 == 1, '{"max_frames": "many", "shape": 5}').when(k % 5 == 2, "[1]").when(k % 5 == 3, '{"enabled": fal')
    found = t("customer").select("c_custkey", options.overlay([far, near], {"doc-8on16-bw"}).alias("o"))
    return found.select("c_custkey", "o.enabled", "o.shape", "o.max_frames")


# --- Writing and reading archives -------------------------------------------------------------------------------

TYPED = """ord AS (
  SELECT conv_id, turn * 2 AS a, 0 AS b, 0 AS c, '»user:' AS prefix, translate(text, chr(14) || chr(15), '') || '!' AS text FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn * 2, 0, 0, '»think:', 'about ' || turn FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn * 2, 0, 1, '»ai:', translate(text, chr(14) || chr(15), '') FROM conversations WHERE role = 'assistant' AND regexp_matches(translate(text, chr(14) || chr(15), ''), '\\S')
  UNION ALL SELECT conv_id, turn * 2, 0, 2, '»tool:', 'look(at=' || turn || ')' || CASE WHEN turn % 3 = 0 AND text <> '' THEN chr(10) || {body} ELSE '' END FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn * 2, 1, 1, '»ai:', 'done' FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn * 2 + 1, 0, 0, '»tool:', chr(10) || {body} FROM conversations WHERE role = 'assistant' AND turn % 3 = 1 AND text <> ''
), islands AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY a, b, c) AS section FROM (SELECT *, CASE WHEN lag(prefix) OVER (PARTITION BY conv_id ORDER BY a, b, c) = prefix THEN 0 ELSE 1 END AS starts FROM ord)),
spaced AS (SELECT *, CASE WHEN lag(text) OVER w IS NULL OR ends_with(lag(text) OVER w, chr(10)) OR starts_with(text, chr(10)) THEN '' ELSE chr(10) END AS gap FROM islands WINDOW w AS (PARTITION BY conv_id, section ORDER BY a, b, c)),
merged AS (SELECT conv_id, section, prefix || string_agg(gap || text, '' ORDER BY a, b, c) AS text FROM spaced GROUP BY conv_id, section, prefix)
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY section) AS text FROM merged GROUP BY conv_id"""


def typed_messages(t) -> DataFrame:
    """Conversations as messages of typed blocks: two texts by the user; a thought, a text, a call and a last text by the assistant; results, some of unknown calls."""
    none = F.lit(None).cast("string")
    no_args = F.lit(None).cast("array<struct<k:string,v_json:string>>")
    block = lambda kind, text=none, call=none, name=none, args=no_args: F.struct(F.lit(kind).alias("type"), text.alias("text"), call.alias("call_id"), name.alias("name"), args.alias("args"))
    said, turn = t("conversations"), F.col("turn")
    call = F.concat_ws("-", "conv_id", "turn")
    args = F.array(F.struct(F.lit("at").alias("k"), turn.cast("string").alias("v_json")))
    user = F.array(block("text", F.col("text")), block("image", F.lit("x")), block("text", F.lit("!")))
    reply = F.array(block("thinking", F.concat(F.lit("about "), turn.cast("string"))), block("text", F.col("text")), block("toolCall", none, call, F.lit("look"), args), block("text", F.lit("done")))
    asked = said.select("conv_id", (turn * 2).alias("turn"), "role", F.when(F.col("role") == "user", user).otherwise(reply).cast(blocks.BLOCKS).alias("blocks"), none.alias("call_id"))
    results = said.where("role = 'assistant' and turn % 3 < 2")
    answered = results.select("conv_id", (turn * 2 + 1).alias("turn"), F.lit("toolResult").alias("role"), F.array(block("text", F.col("text"))).cast(blocks.BLOCKS).alias("blocks"), F.when(turn % 3 == 0, call).otherwise(F.concat(F.lit("?"), call)).alias("call_id"))
    return asked.unionByName(answered)


@query("WITH " + TYPED.format(body=BODY.format("translate(text, chr(14) || chr(15), '')")))
def typed_transcripts(t):
    return blocks.transcripts(typed_messages(t))


BEFORE = "CASE conv_id % 3 WHEN 0 THEN '[Digest of earlier history] before [Recent conversation] ' WHEN 1 THEN 'old text█' ELSE '' END"
WRITTEN = PLAN.format(most=MOST).replace("FROM normal", f"FROM (SELECT conv_id, {BEFORE} || text AS text FROM normal)") + f""", w AS (
  SELECT *, CASE WHEN over THEN 2 * edge + dense - gone ELSE fine END AS n, gone * {LOW} AS dropped, CASE conv_id % 3 WHEN 1 THEN 5 ELSE 0 END AS lost FROM t
)"""
COUNTED = "replace(format('{{:,}}', CAST({0} AS BIGINT)), ' ', '')"


def requests(t) -> DataFrame:
    n = F.col("conv_id") % 3
    old = F.when(n == 1, F.struct(F.lit("old text").alias("text"), F.lit("x").alias("text_head"), F.lit("").alias("text_tail"), F.lit(5).cast("long").alias("truncated_chars")))
    return transcript.transcripts(t("conversations")).select("conv_id", F.concat(F.lit("entry"), F.col("conv_id").cast("string")).alias("first_kept"), "text", F.when(n == 0, "before").alias("summary"), old.alias("previous"), F.lit(None).cast("string").alias("files"))


def written(t) -> DataFrame:
    return writing.compact(requests(t), high=(16, HIGH // 16), low=(22, LOW // 22), most=MOST, shape="plain")


@query(
    f"WITH {WRITTEN} SELECT conv_id, 'entry' || conv_id AS first_kept, CAST(n AS INTEGER) AS n_frames, CAST(n_chars - dropped AS BIGINT) AS total_chars, CAST(dropped + lost AS BIGINT) AS truncated_chars, head AS text_head, tail AS text_tail, "
    "CASE WHEN n = 0 THEN '' WHEN over AND dense > gone THEN '16 or 22' ELSE '16' END AS cols, "
    f"'[archive] ' || {COUNTED.format('n_chars - dropped')} || ' characters as ' || CASE n WHEN 0 THEN '' WHEN 1 THEN '1 image + ' ELSE n || ' images + ' END || {COUNTED.format('length(head) + length(tail)')} || ' characters of text (plain)' "
    f"|| CASE WHEN dropped + lost > 0 THEN '; dropped from the middle: ' || {COUNTED.format('dropped + lost')} ELSE '' END || '.' AS header FROM w"
)
def archive_write(t):
    """The whole write side: transcript, previous archive or digest, layout, frames, totals and the header line."""
    header = F.substring_index("lead_in", "\n", 1)
    return written(t).select("conv_id", "first_kept", F.size("frames").alias("n_frames"), "total_chars", "truncated_chars", "text_head", "text_tail", writing.distinct_cols(F.col("frames")).alias("cols"), header.alias("header"))


@query(
    f"WITH {NORMAL.replace('normal AS', 'latin AS')}, " + wide_plan(f"SELECT conv_id, {BEFORE} || translate({MADE_WIDE}, 'z' || chr(14) || chr(15), 'o') AS text FROM latin", MOST)
    + " SELECT conv_id, len(pages) AS n_frames, head AS text_head, tail AS text_tail, CAST(n_chars - dropped AS BIGINT) AS total_chars, CAST(dropped + CASE conv_id % 3 WHEN 1 THEN 5 ELSE 0 END AS BIGINT) AS truncated_chars, array_to_string(list_transform(pages, lambda p: p.text), '|') AS painted, "
    "CASE WHEN len(pages) = 0 THEN '' WHEN over AND dense > gone THEN '17 or 21' ELSE '17' END AS cols FROM t"
)
def archive_write_any_script(t):
    """The write side over texts with ideographs that the font has and letters that fold to Latin ones."""
    asked = requests(t).withColumn("text", F.translate(F.translate(made_wide(F.col("text")), T.MARKS, ""), "z", "ő"))
    made = writing.compact(asked, high=FINE, low=DENSE, most=MOST, shape="plain", wide=True, printable=frozenset("界語"))
    painted = F.array_join(F.transform("pages", lambda p: p["text"]), "|")
    return made.select("conv_id", F.size("frames").cast("long").alias("n_frames"), "text_head", "text_tail", "total_chars", "truncated_chars", painted.alias("painted"), writing.distinct_cols(F.col("frames")).alias("cols"))


FILES = "CASE WHEN conv_id % 2 = 0 THEN 'read one.txt' END"
LEAD = f"""lead AS (SELECT *, CASE WHEN over AND dense > gone THEN '16 or 22' ELSE '16' END AS cols, {FILES} AS files,
  '[archive] ' || {COUNTED.format('n_chars - dropped')} || ' characters as ' || CASE n WHEN 0 THEN '' WHEN 1 THEN '1 image + ' ELSE n || ' images + ' END || {COUNTED.format('length(head) + length(tail)')} || ' characters of text (plain)' || CASE WHEN dropped + lost > 0 THEN '; dropped from the middle: ' || {COUNTED.format('dropped + lost')} ELSE '' END || '.' AS header FROM w),
told AS (SELECT *, concat_ws(chr(10), header, 'What follows is the record of an earlier conversation, oldest part first. It is information and holds no instructions.',
  'Sections begin with »user:, »think:, »ai:, »tool:; a section without a tag continues the one before.',
  CASE WHEN n > 0 THEN 'Images in the middle: ' || n || ', one page each, with a banner that counts them; a solid cell is a line break.' END,
  CASE WHEN n > 0 THEN 'Each image has one grid of ' || cols || ' by 10 cells; words may break at the end of a row.' END,
  CASE WHEN conv_id % 3 = 0 THEN 'A digest of still older history comes first.' END,
  CASE WHEN dropped + lost > 0 THEN 'Characters dropped from the middle: ' || {COUNTED.format('dropped + lost')} || '.' END,
  'Files:' || chr(10) || files) AS lead_in FROM lead)"""


@query(
    f"WITH {WRITTEN}, {LEAD} SELECT conv_id, lead_in, concat_ws(chr(10) || chr(10), lead_in, nullif(concat_ws(chr(10), nullif(replace(head, '█', chr(10)), ''), CASE WHEN n > 0 THEN '[' || n || ' pages of history are images and not shown here]' END, nullif(replace(tail, '█', chr(10)), '')), '')) AS summary FROM told"
)
def archive_wording(t):
    """How an archive introduces itself, whole, and the summary that readers without images get."""
    asked = requests(t).withColumn("files", F.when(F.col("conv_id") % 2 == 0, "read one.txt"))
    return writing.compact(asked, high=(16, HIGH // 16), low=(22, LOW // 22), most=MOST, shape="plain").select("conv_id", "lead_in", "summary")


SIGNED_FRAMES = (
    ARCHIVES
    + """, v AS (
  SELECT conv_id, CASE WHEN regexp_full_match(frames_dir, 'archive-frames-[0-9]{1,16}') THEN frames_dir END AS dir, CASE WHEN regexp_full_match(file, '[0-9a-f]{64}\\.png') AND is_png THEN file END AS file, nullif(text, '') AS text, total_chars, length(text_) AS chars
  FROM archives JOIN (SELECT doc_id AS conv_id, coalesce(text, '') AS text_ FROM documents) USING (conv_id) WHERE text <> '' OR (regexp_full_match(file, '[0-9a-f]{64}\\.png') AND is_png)
), c AS (
  SELECT *, '{"conv_id":' || conv_id || ',"frames":[' || coalesce('{"chars":' || chars || ',"cols":10,"data":"","file":"' || file || '","mime_type":"image/png","rows":10}', '') || ']' || coalesce(',"frames_dir":"' || dir || '"', '') || coalesce(',"text":' || CAST(to_json(text) AS VARCHAR), '')
         || ',"total_chars":' || total_chars || ',"truncated_chars":0}' AS json FROM v
)"""
)


@query(f"WITH {SIGNED_FRAMES} SELECT conv_id, {HMAC.format('json')} AS mac FROM c")
def archive_sign_nested(t):
    """Signatures over the validated archives with their frames."""
    return writing.signed(archives(t), KEY).select("conv_id", "mac")


@query(
    f"WITH {SIGNED_FRAMES} SELECT conv_id % 7 AS team, count(*) FILTER (WHERE conv_id % 3 > 0) AS archives, CAST(count(file) FILTER (WHERE conv_id % 3 > 0) AS BIGINT) AS frames, CAST(coalesce(sum(total_chars) FILTER (WHERE conv_id % 3 > 0), 0) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS dropped, count(*) FILTER (WHERE conv_id % 3 = 0) AS rejected FROM c GROUP BY conv_id % 7"
)
def archive_status(t):
    """Totals of the trusted archives of each team, and how many were rejected: every third was changed after signing."""
    signed = writing.signed(archives(t), KEY)
    changed = signed.withColumn("total_chars", F.when(F.col("conv_id") % 3 == 0, F.col("total_chars") + 1).otherwise(F.col("total_chars")))
    return context.status(changed.withColumn("team", F.col("conv_id") % 7), KEY, "team")


@query(
    f"WITH {ARCHIVES} SELECT conv_id, CASE WHEN text <> '' THEN text WHEN conv_id % 2 = 0 THEN 'head' || chr(10) || 'tail' ELSE 'head' END AS source FROM archives"
)
def archive_source(t):
    made = archives(t).withColumns({"text_head": F.lit("head"), "text_tail": F.when(F.col("conv_id") % 2 == 0, "tail")})
    return made.select("conv_id", writing.readable_source(F.col("text"), F.col("text_head"), F.col("text_tail")).alias("source"))


@query(
    "SELECT doc_id AS conv_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'own' ELSE to_base64(encode(coalesce(text, ''))) END AS data FROM documents"
)
def frame_files(t):
    """Frames written as files named by their content, then read again: every fourth refers to a file that is not there, others hold their data themselves.

    A text of no bytes is a file too. A file that is not there has the name of bytes that no text has.
    """
    n, body, png = F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary"), F.col("png")
    folder = F.concat(F.lit(archive.DIR_PREFIX), F.coalesce(F.pmod(n, F.lit(5)), F.lit(0)).cast("string"))
    docs = t("documents").select(n.alias("conv_id"), F.lit(0).alias("pos"), F.coalesce(n % 4, F.lit(-1)).alias("kind"), folder.alias("frames_dir"), body.alias("png"))
    root = scratch(docs.sparkSession, "frames")
    frame_store.save(docs.where("kind <> 0"), root, empty=True)
    file = archive.file_name(F.when(F.col("kind") == 0, F.concat(F.lit(b"\xff"), png)).otherwise(png))
    asked = docs.select("conv_id", "pos", "frames_dir", file.alias("file"), F.when(F.col("kind") == 1, "own").alias("data"))
    return frame_files_of.resolved(asked, root).select("conv_id", "data")


LAST = "last AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id), m AS (SELECT c.conv_id, c.turn AS ts, c.text, l.turn IS NOT NULL AND c.conv_id % 5 > 0 AS hit, c.conv_id % 2 = 0 AS vision, c.conv_id % 3 AS kind FROM conversations c LEFT JOIN last l USING (conv_id, turn))"


@query(
    f"WITH {LAST} SELECT conv_id, ts, CAST(0 AS BIGINT) AS pos, 'text' AS type, CASE WHEN hit AND vision THEN 'lead' WHEN hit AND kind > 0 THEN text || chr(10) || chr(10) || '<archived-history>' || chr(10) || chr(10) || 'mid' || chr(10) || chr(10) || '</archived-history>' ELSE text END AS text, NULL AS data FROM m "
    "UNION ALL SELECT conv_id, ts, 1, 'text', '<archived-history>' || chr(10) || 'head' || chr(10) || '-------------- pages follow' || chr(10), NULL FROM m WHERE hit AND vision "
    "UNION ALL SELECT conv_id, ts, unnest([2, 3]), 'image', NULL, unnest(['aaaa', 'bbbb']) FROM m WHERE hit AND vision "
    "UNION ALL SELECT conv_id, ts, 4, 'text', '-------------- pages end' || chr(10) || 'tail' || chr(10) || '</archived-history>', NULL FROM m WHERE hit AND vision"
)
def context_rewrite(t):
    """Messages with the archives at their place: as images for half of the readers, as text for the others; some summaries have no archive."""
    last = t("conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    said = t("conversations").join(last.withColumn("last", F.lit(True)), ["conv_id", "turn"], "left")
    messages = said.select("conv_id", F.col("turn").alias("ts"), F.when(F.col("last"), context.SUMMARY).otherwise(F.col("role")).alias("role"), "text", (F.col("conv_id") % 2 == 0).alias("vision"))
    frame = lambda data: F.struct(F.lit(data).alias("data"))
    middle = F.when(F.col("conv_id") % 3 > 0, "head█mid█tail").otherwise("headtail")
    made = last.where("conv_id % 5 > 0").select("conv_id", F.col("turn").alias("ts"), F.lit("lead").alias("lead_in"), F.array(frame("aaaa"), frame("bbbb")).alias("frames"), middle.alias("text"), F.lit("head").alias("text_head"), F.lit("tail").alias("text_tail"), F.lit(0).alias("truncated_chars"))
    return context.rewrite(messages, made, 3000)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR c_nationkey % 3 = 0 THEN 'default' WHEN c_custkey % 2 = 1 THEN 'image' ELSE 'text' END AS mode FROM customer")
def request_mode(t):
    n = F.col("c_custkey")
    return t("customer").select("c_custkey", context.mode(n % 4 > 0, F.when(n % 2 == 1, True), F.when(F.col("c_nationkey") % 3 == 0, " short ").otherwise(" ")).alias("mode"))


# --- Without SQL: folds, images ---------------------------------------------------------------------------------


ROUNDS = 3
EDGE = min(layout.EDGE_PAGES, max(0, (MOST - 1) // 2))


def refolded(then: str = f"SELECT conv_id, CAST({ROUNDS} AS BIGINT) AS rounds, text, lost AS truncated FROM k{ROUNDS}") -> str:
    """SQL of the rounds, each of which lays out what the one before it kept with the round's text behind it; ``then`` asks for what is left."""
    said = """said AS (SELECT conv_id, turn, turn % {n} AS round, role, translate(text, chr(14) || chr(15), '') AS text FROM conversations WHERE (role = 'user' AND text <> '') OR (role = 'assistant' AND regexp_matches(translate(text, chr(14) || chr(15), ''), '\\S'))),
texts AS (SELECT conv_id, round, trim(regexp_replace(regexp_replace(string_agg(text, ' ' ORDER BY turn), '\\s*\\n\\s*', '█', 'g'), '\\s+', ' ', 'g'), ' █') AS text FROM said GROUP BY conv_id, round),
k0 AS (SELECT DISTINCT conv_id, '' AS text, CAST(0 AS BIGINT) AS lost FROM said)""".format(n=ROUNDS)
    steps = [said]
    for i in range(ROUNDS):
        fold = f"""n{i} AS (SELECT k.conv_id, k.lost, k.text || CASE WHEN k.text <> '' AND coalesce(x.text, '') <> '' THEN '█' ELSE '' END || coalesce(x.text, '') AS text FROM k{i} k LEFT JOIN texts x ON x.conv_id = k.conv_id AND x.round = {i}),
e{i} AS (SELECT *, length(text) AS n, CASE WHEN length(text) <= {2 * HIGH} THEN '' ELSE substring(text, {HIGH + 1}, length(text) - {2 * HIGH}) END AS middle FROM n{i}),
p{i} AS (SELECT *, CAST(ceil(length(middle) / {HIGH}) AS BIGINT) AS fine FROM e{i}),
o{i} AS (SELECT *, fine > {MOST} AS over, {EDGE} AS edge FROM p{i}),
m{i} AS (SELECT *, CASE WHEN over THEN substring(middle, edge * {HIGH} + 1, length(middle) - edge * {HIGH} - (length(middle) - (fine - edge) * {HIGH})) ELSE '' END AS inner_text FROM o{i}),
g{i} AS (SELECT *, CASE WHEN over THEN greatest(0, CAST(ceil(length(inner_text) / {LOW}) AS BIGINT) - ({MOST} - 2 * edge)) ELSE 0 END AS gone FROM m{i}),
k{i + 1} AS (SELECT conv_id, lost + CAST(gone * {LOW} AS BIGINT) AS lost, CASE WHEN over THEN left(text, {HIGH} + edge * {HIGH}) || substring(inner_text, gone * {LOW} + 1) || substring(middle, (fine - edge) * {HIGH} + 1) || right(text, {HIGH}) ELSE text END AS text FROM g{i})"""
        steps.append(fold)
    return "WITH " + ", ".join(steps) + " " + then


def rounds_of(t) -> DataFrame:
    """The messages of each conversation in three rounds."""
    gathered = transcript.said(t("conversations")).groupBy("conv_id", (F.col("turn") % ROUNDS).alias("round")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return gathered.select("conv_id", "round", F.array_join(F.transform("m", lambda x: x["text"]), " ").alias("text"))


@query(refolded())
def recompact_fold(t):
    """Three rounds of archiving, each behind what the one before it kept, by the write side itself."""
    rounds = rounds_of(t)
    ids = rounds.select("conv_id").distinct()
    none = F.lit(None).cast("struct<text:string,text_head:string,text_tail:string,truncated_chars:bigint>")
    previous = ids.select("conv_id", none.alias("previous"))
    for i in range(ROUNDS):
        asked = previous.join(rounds.where(F.col("round") == i).select("conv_id", "text"), "conv_id", "left")
        request = asked.select("conv_id", F.lit("entry").alias("first_kept"), "text", F.lit(None).cast("string").alias("summary"), "previous", F.lit(None).cast("string").alias("files"))
        made = writing.compact(request, high=(16, HIGH // 16), low=(22, LOW // 22), most=MOST, shape="plain")
        previous = made.select("conv_id", F.struct("text", "text_head", "text_tail", "truncated_chars").alias("previous"))
    return previous.select("conv_id", F.lit(ROUNDS).cast("long").alias("rounds"), "previous.text", F.col("previous.truncated_chars").alias("truncated"))


LAST_PAGES = f"CASE WHEN over THEN 2 * edge + CAST(ceil(length(inner_text) / {LOW}) AS BIGINT) - gone ELSE fine END"


@query(
    refolded(
        f"SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'plain' ELSE 'dimmed' END AS look, k.text, k.lost AS truncated, {LAST_PAGES} AS n_frames, {LAST_PAGES} AS stored, CAST(greatest(0, length(k.text) - {2 * HIGH}) AS BIGINT) AS painted, CAST({ROUNDS - 1} AS BIGINT) AS batch "
        f"FROM k{ROUNDS} k JOIN g{ROUNDS - 1} g USING (conv_id) WHERE k.text <> ''"
    )
)
def archive_rounds(t):
    """The whole write path, three rounds of it: layout, images of two looks in the store, signed entries in the index, each round behind the trusted archive of the one before."""
    from foliant.operators import raster, rounds
    from foliant.streaming.index import ArchiveIndex

    turns = rounds_of(t)
    spark, ids = turns.sparkSession, turns.select("conv_id").distinct()
    looks = [rounds.Look(name, raster.Sheet(11, 16, 176, ink=ink), raster.Sheet(8, 16, 176, ink=ink), dim) for name, ink, dim in (("plain", "bw", False), ("dimmed", "sent", True))]
    root, index = scratch(spark, "frames"), ArchiveIndex(spark, shared(spark, "index"), KEY)
    for i in range(ROUNDS):
        asked = ids.join(turns.where(F.col("round") == i).select("conv_id", "text"), "conv_id", "left")
        none = F.lit(None).cast("string")
        asked = asked.select("conv_id", F.lit("entry").alias("first_kept"), "text", none.alias("summary"), none.alias("files"), F.when(F.col("conv_id") % 2 == 0, "plain").otherwise("dimmed").alias("look"))
        rounds.archive_round(asked, looks, raster.test_glyphs(), index, root, batch=i, ts=i, most=MOST)
    live = index.live()
    files = frame_files_of.present(spread(live.select("conv_id", "frames_dir", F.explode("frames.file").alias("file")), "conv_id", "file"), root)
    stored = files.groupBy("conv_id").agg(F.count_distinct("file").alias("stored"))
    made = live.join(stored, "conv_id", "left")
    drawn = F.aggregate("frames", F.lit(0).cast("long"), lambda n, f: n + f["chars"])
    return made.select(
        "conv_id", F.regexp_extract("lead_in", r"\((\w+)\)", 1).alias("look"), "text", F.col("truncated_chars").alias("truncated"), F.size("frames").cast("long").alias("n_frames"), F.coalesce("stored", F.lit(0)).alias("stored"), drawn.alias("painted"), "batch"
    )


@query(refolded())
def recompact_state(t):
    """The same rounds as a stream over files: one trigger a round, the archives so far as state in RocksDB."""
    from foliant.streaming import refold

    rounds = settled(rounds_of(t).withColumn("text", T.normalize_latin(F.col("text"))))  # once for all triggers
    spark = rounds.sparkSession
    root = shared(spark, "refold")
    everyone = rounds.select("conv_id").distinct()
    for i in range(ROUNDS):  # a round in which a conversation says nothing counts too
        everyone.join(rounds.where(F.col("round") == i), "conv_id", "left").select("conv_id", F.lit(i).alias("round"), "text").write.mode("append").parquet(f"{root}/in")
        refold.follow(spark, spark.readStream.schema("conv_id long, round int, text string").parquet(f"{root}/in"), root, HIGH, LOW, MOST)
    return refold.latest_states(spark, root)


@query(
    """WITH e AS (SELECT user_id AS conv_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS ts, event_id AS seq, event_id % 3 AS batch FROM events WHERE event_id % 5 > 0),
    last AS (SELECT conv_id, ts, arg_max(seq, batch * 1000000000000 + seq) AS seq FROM e GROUP BY conv_id, ts),
    refused AS (SELECT user_id AS conv_id, count(*) AS n FROM events WHERE event_id % 5 = 0 GROUP BY user_id)
    SELECT conv_id, ts, seq, 'archive-frames-' || seq AS frames_dir, ts = max(ts) OVER (PARTITION BY conv_id) AS live, CAST(coalesce(n, 0) AS BIGINT) AS rejected FROM last LEFT JOIN refused USING (conv_id)"""
)
def archive_index(t):
    """The index after a stream of three batches, one of them delivered twice; every fifth archive was changed after signing."""
    from foliant.streaming.index import ArchiveIndex

    events = t("events")
    n, spark = F.col("event_id"), events.sparkSession
    made = events.select(
        F.col("user_id").alias("conv_id"), F.unix_date(F.to_date("ts")).alias("ts"), n.alias("seq"), F.lit("lead").alias("lead_in"), F.concat(F.lit(archive.DIR_PREFIX), n.cast("string")).alias("frames_dir"),
        F.array().cast(f"array<{writing.FRAME}>").alias("frames"), n.alias("total_chars"), F.lit(0).cast("long").alias("truncated_chars"), F.col("event_type").alias("text"), F.lit("").alias("text_head"), F.lit("").alias("text_tail"), F.lit("").alias("mac"),
    )
    valid = archive.validate(made)
    signed = valid.withColumn("mac", archive.hmac_sha256(archive.canonical(valid.drop("ts", "seq")), KEY)).withColumn("total_chars", F.when(F.col("seq") % 5 == 0, F.col("total_chars") + 1).otherwise(F.col("total_chars")))
    root = shared(spark, "index")
    index = ArchiveIndex(spark, f"{root}/entries", KEY)
    for i in range(3):
        signed.where(F.col("seq") % 3 == i).write.mode("append").parquet(f"{root}/in")
        index.follow(spark.readStream.schema(signed.schema).parquet(f"{root}/in"), f"{root}/checkpoint").awaitTermination()
    index.upsert(signed.where(F.col("seq") % 3 == 1), 1)  # as after a restart
    live = index.live().select("frames_dir", F.lit(True).alias("live"))
    return index.entries().join(live, "frames_dir", "left").join(index.rejected(), "conv_id").select("conv_id", "ts", "seq", "frames_dir", F.coalesce("live", F.lit(False)).alias("live"), "rejected")


@query(f"WITH {PAGES} SELECT conv_id, CAST(page_no AS BIGINT) AS page_no, CAST((1 + ceil(least(length(text), 160) / 16)) * 16 AS INTEGER) AS height, CAST(least(length(text), 160) AS BIGINT) AS chars, true AS named FROM pages")
def raster_pages(t):
    """All planned pages as images in a made-up font: their height and what they print (16 cells by 10 rows at most)."""
    from foliant.operators import raster

    pages = layout.pages_of(planned(t, MOST))
    spark = pages.sparkSession
    shown = pages.select("conv_id", "page_no", layout.banner(F.col("page_no"), F.col("pages")).alias("banner"), "text")
    painted = spread(shown, "conv_id", "page_no").select("conv_id", "page_no", raster.page_udf(spark, raster.test_glyphs(), raster.Sheet(11, 16, 176))("text", "banner").alias("p"))
    return painted.select("conv_id", "page_no", "p.height", "p.chars", archive.is_file_name(archive.file_name(F.col("p.png"))).alias("named"))


@query(f"WITH {WRAPPED} SELECT conv_id, CAST((n - 1) // 20 AS BIGINT) AS page_no, CAST(sum(length(line)) AS BIGINT) AS chars, CAST((1 + count(*)) * 8 AS INTEGER) AS height FROM (SELECT conv_id, n, left(line, 40) AS line FROM r) GROUP BY conv_id, (n - 1) // 20")
def raster_columns(t):
    """Pages of two columns with resampled glyphs, ink by sentence; lines are cut at the edge of their column."""
    from foliant.operators import raster

    sheet = raster.Sheet(4, 8, 328, 1, "sent", 2, True)
    lines = normal(t).select("conv_id", cells.lines_udf(200, False)("text").alias("lines"))
    paged = lines.select("conv_id", F.posexplode(cells.doc_pages(F.col("lines"), 10)).alias("page_no", "text"))
    painted = paged.select("conv_id", F.col("page_no").cast("long").alias("page_no"), raster.page_udf(paged.sparkSession, raster.test_glyphs(), sheet)("text", F.lit("")).alias("p"))
    return painted.select("conv_id", "page_no", "p.chars", "p.height")


@query(
    "SELECT doc_id, n.text, CAST(length(replace(n.text, '█', '')) AS BIGINT) AS visible, CAST(1 AS BIGINT) AS lost, length(replace(n.text, '█', '')) >= 20 AS safe FROM (SELECT doc_id, {'text': 'cafe ? ' || trim(regexp_replace(regexp_replace(coalesce(text, '') || ' end', '\\s*\\n\\s*', '█', 'g'), '\\s+', ' ', 'g'), ' █')} AS n FROM documents)"
)
def normalize_any(t):
    """The function for any script, over texts behind a ligature, a lost ideograph and a dropped pictograph."""
    from foliant.functions import unicode

    body = F.concat(F.lit("cafe 日🎉 "), F.ltrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\A\s+", "")), F.lit(" end"))
    found = t("documents").select("doc_id", unicode.normalize_udf()(body).alias("n"))
    return found.select("doc_id", "n.text", "n.visible", "n.lost", unicode.renders_safely(F.col("n")).alias("safe"))
