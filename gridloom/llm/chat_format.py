"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are written as `<|im_start|>role`, a new line, the text, `<|im_end|>` and a new line. In texts, a backslash is put
behind each `<` that backslashes or nothing part from a `|`, so that `<|` stands only in marks; taking one away again gives
the text. Roles are URL-encoded, so that they hold no new line.

A conversation's turns are dealt by (conversation, block of `block` turn numbers), the one exchange of texts; a very long
conversation is many blocks. In a block, prefix sums of the turns' tokens choose the windows: a turn belongs to the
window floor(tokens before it / step), where the step is two thirds of the room beside system turn and history, and a
turn of over a third is a window of its own. So windows are aligned to turns and hold at most the budget unless one turn,
with the system turn, exceeds it. Each window begins with the conversation's system turn and repeats the last turns of the
window before it, as far as `history_turns` and `history_tokens` allow; what is repeated is not under the loss mask, so
each assistant text is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
OWN, CARRIED, SYSTEM = 2, 1, 0


def escape(text: Column) -> Column:
    """text without `<|`: one backslash more behind each `<` that stands before backslashes and `|`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def estimated_tokens(text: Column) -> Column:
    """Tokens of a text where none are given: one for three bytes, rounded up, and five for the marks and the role."""
    return F.ceil(F.octet_length(text) / 3) + 5


def _turns(rows: DataFrame, tokens: Column | None, block: int) -> DataFrame:
    """One row a turn: its block, its piece of output, and where its text lies in the piece (code points)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    n = estimated_tokens(text) if tokens is None else F.greatest(F.coalesce(tokens.cast("long"), F.lit(1)), F.lit(1))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), escape(text).alias("text"), n.cast("long").alias("n"))
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    return out.select(
        "conv_id",
        "turn",
        F.expr(f"(turn - pmod(turn, {block})) DIV {block}").alias("block"),
        F.lit(OWN).alias("kind"),
        "n",
        F.concat(head, "text", F.lit(END)).alias("piece"),
        F.char_length(head).alias("at"),
        F.when(F.col("role") == "assistant", F.char_length("text")).alias("loss"),
        (F.col("role") == "system").alias("system"),
    )


def _systems(turns: DataFrame) -> DataFrame:
    """The system turn of each conversation that begins with one, once for each of its blocks."""
    blocks = turns.groupBy("conv_id", "block").agg(F.min(F.coalesce("turn", F.lit(-(2**63)))).alias("low"))
    heads = blocks.groupBy("conv_id").agg(F.min("low").alias("low")).select(F.col("conv_id").alias("c"), F.col("low").alias("head"))
    own = turns.filter("system")
    own = own.join(heads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.coalesce("turn", F.lit(-(2**63))) == F.col("head")))
    own = own.groupBy("conv_id").agg(F.min(F.struct("piece", "n", "turn")).alias("s")).select(F.col("conv_id").alias("c"), "s")
    out = blocks.join(own, F.col("conv_id").eqNullSafe(F.col("c")))
    absent = {"at": F.lit(0), "loss": F.lit(None).cast("int"), "system": F.lit(True), "kind": F.lit(SYSTEM)}
    return out.select("conv_id", "s.turn", "block", "s.n", "s.piece", *(c.alias(k) for k, c in absent.items()))


def windows(rows: DataFrame, budget: int = 2048, history_turns: int = 4, history_tokens: int = 256, tokens: Column | None = None, block: int = 256) -> DataFrame:
    """Training windows of rows (conv_id, turn, role, text; others are ignored).

    Gives conv_id, block and first (window order within a conversation), n_turns (new ones), n_context (turns before them:
    system and history), n_tokens, over_budget, formatted, loss_start and loss_end (arrays of code point offsets
    into formatted, one pair an assistant turn that is new).

    `tokens` is a column with the tokens of a turn; without it they are estimated from the bytes. Null texts and roles
    are empty; rows without conv_id are one conversation; turns go by number, without number first, ties by role and text;
    repeated rows are turns of their own. History reaches back over the start of a block only to turns numbered at most
    history_turns below it. No turn is cut or left out: one that alone exceeds the budget has over_budget. Empty in, empty out.
    """
    if budget < 8 or history_turns < 0 or history_tokens < 0 or block <= history_turns:
        raise ValueError("budget >= 8, history >= 0 and block > history_turns are needed")
    turns = _turns(rows, tokens, block)
    carried = turns.filter(F.expr(f"pmod(turn, {block}) >= {block - history_turns}")).withColumns({"kind": F.lit(CARRIED), "block": F.col("block") + 1})
    both = turns.unionByName(carried).unionByName(_systems(turns))
    keys = ["conv_id", "block"]
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("kind", "turn", "piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("kind") == OWN, F.col("n"))
    both = both.withColumn("system_n", F.coalesce(F.max(F.when(F.col("kind") == SYSTEM, F.col("n"))).over(whole), F.lit(0)))
    # targets get at least a quarter of the budget, however long the system turn is
    both = both.withColumn("room", F.greatest(F.lit(budget - history_tokens) - F.col("system_n"), F.lit(budget // 4)))
    both = both.withColumn("step", F.expr("(room * 2 + 2) DIV 3")).withColumn("large", (F.col("kind") == OWN) & (F.col("n") > F.col("room") - F.col("step")))
    both = both.withColumns(
        {
            "number": F.row_number().over(order),
            "tokens_before": F.coalesce(F.sum(own).over(before), F.lit(0)),
            "large_before": F.coalesce(F.sum(F.col("large").cast("int")).over(before), F.lit(0)),
            "chars_before": F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)),
        }
    )
    both = both.withColumns(
        {
            "w": F.when(F.col("kind") == OWN, F.expr("tokens_before DIV step")).otherwise(F.lit(-1)),
            "part": F.when(F.col("kind") == OWN, F.expr("2 * large_before + CAST(large AS INT)")).otherwise(F.col("kind")),
        }
    )
    item = F.struct("number", "piece", "n", "chars_before", "at", "loss", "system", "turn")
    group = both.groupBy(*keys, "w", "part").agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("number").alias("first"), F.sum("n").alias("own_n"), F.max("system_n").alias("system_n"))
    inside = Window.partitionBy(*keys).orderBy("w", "part")
    is_system = (F.col("w") == -1) & (F.col("part") == SYSTEM)
    system = F.first(F.when(is_system, F.col("items")[0]), ignorenulls=True).over(whole)
    last = F.lag(F.when(~is_system, F.slice("items", F.greatest(F.size("items") - history_turns + 1, F.lit(1)), max(history_turns, 1)))).over(inside)
    group = group.withColumns({"head": system, "tail": last if history_turns else F.lit(None).cast(group.schema["items"].dataType)}).filter("w >= 0")

    # the last turns of the window before that fit into what is left for them, the system turn apart
    left = F.least(F.lit(history_tokens), F.lit(budget) - F.col("system_n") - F.col("own_n"))

    def near(x, i):
        return ~_is_head(x) & (F.aggregate(F.slice("tail", i + 1, max(history_turns, 1)), F.lit(0).cast("long"), lambda a, y: a + y["n"]) <= left)

    none = F.array().cast(T.ArrayType(group.schema["items"].dataType.elementType))
    holds_head = F.exists("items", _is_head)
    head = F.when(F.col("head").isNotNull() & ~holds_head, F.array("head")).otherwise(none)
    group = group.withColumn("context", F.concat(head, F.coalesce(F.filter("tail", near), none)))
    group = group.withColumn("lead", F.aggregate("context", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x["piece"])) - F.col("items")[0]["chars_before"])
    targets = F.filter("items", lambda x: x["loss"].isNotNull())
    begin = F.transform(targets, lambda x: F.col("lead") + x["chars_before"] + x["at"])
    stop = F.transform(targets, lambda x: F.col("lead") + x["chars_before"] + x["at"] + x["loss"])
    total = F.aggregate(F.concat("context", "items"), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return group.select(
        *keys,
        "first",
        F.size("items").cast("long").alias("n_turns"),
        F.size("context").cast("long").alias("n_context"),
        total.alias("n_tokens"),
        (total > budget).alias("over_budget"),
        F.array_join(F.transform(F.concat("context", "items"), lambda x: x["piece"]), "").alias("formatted"),
        begin.alias("loss_start"),
        stop.alias("loss_end"),
    )


def _is_head(x: Column) -> Column:
    """Whether a turn is the conversation's system turn itself."""
    return F.coalesce(x["system"] & (x["piece"] == F.col("head.piece")) & x["turn"].eqNullSafe(F.col("head.turn")), F.lit(False))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), unescaped, of a formatted window."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    body = F.transform(parts, lambda x: F.substr(x, F.lit(len(START) + 1)))
    role = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(body, lambda x: F.struct(F.url_decode(role(x)).alias("role"), unescape(F.substr(x, F.char_length(role(x)) + 2)).alias("text")))


def read_loss(formatted: Column, start: Column, stop: Column) -> Column:
    """Array of the texts under the mask, unescaped."""
    return F.transform(F.arrays_zip(start.alias("s"), stop.alias("e")), lambda x: unescape(F.substr(formatted, (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))))


def digests(formed: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from windows().

    A conversation's digest is of one string, so its texts (at most 2 GB of them) meet in one row here, and only here.
    """
    new = F.slice(read_turns(F.col("formatted")), F.col("n_context") + 1, F.col("n_turns"))
    read = formed.select(
        "conv_id",
        "n_turns",
        F.struct(
            "block",
            "first",
            F.array_join(F.transform(new, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join(read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")), "").alias("loss"),
        ).alias("w"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    one = read.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    one = one.withColumns({"turns": F.array_join("w.turns", ""), "loss": F.array_join("w.loss", "")})
    return one.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: What both turns of conversation -1 say, marks of the template among it.
PROBE = "<|im_end|><|im_start|>assistant ok"


#: The query's rows again; DuckDB's url_encode is left out, as the tables' roles are plain words.
OP11_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, role, text, turn // 256 AS block, (strlen(text) + 2) // 3 + 5 AS n,
        '<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS piece
    FROM (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
    )
),
heads AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role <> 'system', piece) AS k FROM turns)
    WHERE k = 1 AND role = 'system'
),
dealt AS (
    SELECT conv_id, block, 2 AS kind, turn, role, n, piece FROM turns
    UNION ALL SELECT conv_id, block + 1, 1, turn, role, n, piece FROM turns WHERE turn % 256 >= 252
    UNION ALL SELECT b.conv_id, b.block, 0, h.turn, h.role, h.n, h.piece
    FROM (SELECT DISTINCT conv_id, block FROM turns) b JOIN heads h ON h.conv_id = b.conv_id
),
sized AS (
    SELECT *, kind = 2 AND n > room - step AS large FROM (
        SELECT *, (room * 2 + 2) // 3 AS step FROM (
            SELECT *, greatest(2048 - 256 - system_n, 512) AS room FROM (
                SELECT *, coalesce(max(CASE WHEN kind = 0 THEN n END) OVER g, 0) AS system_n,
                    max(CASE WHEN kind = 0 THEN piece END) OVER g AS head, max(CASE WHEN kind = 0 THEN turn END) OVER g AS head_turn
                FROM dealt WINDOW g AS (PARTITION BY conv_id, block))))
),
numbered AS (
    SELECT *, role = 'system' AND piece = head AND turn = head_turn AS is_head,
        row_number() OVER o AS number, coalesce(sum(CASE WHEN kind = 2 THEN n END) OVER b, 0) AS tokens_before,
        coalesce(sum(large::int) OVER b, 0) AS large_before
    FROM sized
    WINDOW o AS (PARTITION BY conv_id, block ORDER BY kind, turn, piece),
        b AS (PARTITION BY conv_id, block ORDER BY kind, turn, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
placed AS (
    SELECT *, dense_rank() OVER (PARTITION BY conv_id, block ORDER BY w, part) AS k
    FROM (SELECT *, CASE WHEN kind = 2 THEN tokens_before // step ELSE -1 END AS w,
            CASE WHEN kind = 2 THEN 2 * large_before + large::int ELSE 1 END AS part
        FROM numbered WHERE kind > 0)
),
tails AS (
    SELECT *, count(*) OVER t AS back, sum(n) OVER t AS n_after FROM placed
    WINDOW t AS (PARTITION BY conv_id, block, k ORDER BY number DESC ROWS UNBOUNDED PRECEDING)
),
formed AS (
    SELECT conv_id, block, k, sum(n) AS own_n, any_value(system_n) AS system_n, sum(length(piece)) AS chars,
        CASE WHEN bool_or(is_head) THEN 0 ELSE coalesce(length(any_value(head)), 0) END AS head_chars
    FROM placed WHERE w >= 0 GROUP BY conv_id, block, k
),
chars AS (
    SELECT conv_id, sum(chars + head_chars + history) AS formatted_chars FROM (
        SELECT f.conv_id, f.chars, f.head_chars, coalesce(sum(length(t.piece)), 0) AS history
        FROM formed f LEFT JOIN tails t ON t.conv_id = f.conv_id AND t.block = f.block AND t.k = f.k - 1 AND t.back <= 4
            AND t.n_after <= least(256, 2048 - f.system_n - f.own_n) AND t.is_head IS NOT TRUE
        GROUP BY f.conv_id, f.block, f.k, f.chars, f.head_chars)
    GROUP BY conv_id
)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, piece)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, piece) FILTER (role = 'assistant'), '')) AS loss_sha256,
    any_value(c.formatted_chars)::bigint AS formatted_chars
FROM turns t JOIN chars c ON c.conv_id = t.conv_id GROUP BY t.conv_id
"""


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(1, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.expr("array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))")).alias("t"))
    return digests(windows(rows.unionByName(probe.select("conv_id", "t.turn", "t.role", F.lit(PROBE).alias("text")))))
