"""Chat formatting of reply trees, in DataFrame operations only.

A table of messages with parents is a forest.  Its root-to-leaf paths are
enumerated by iterative self-joins: runs of messages with one reply each are
first contracted by pointer doubling (as many joins as the logarithm of the
longest run), then leaf runs are joined to their parent runs level by level.
Branches of a tree are ranked by the sum of their messages' scores, and each
path becomes one string.

Template: a user turn is ``[INST]text[/INST]``, an assistant turn
``<s>text</s>``, any other ``[ROLE name]text[/ROLE]``.  A control string inside
a text gets a backslash after its first character (one more if it has some),
which ``parse`` takes away again.

Cases: null texts count as empty, a null role is ``[ROLE]``; a message whose
parent isn't in the table starts a tree; messages on a circle of parents, and
those below one, have no root and so no path; ties of score are broken by the leaf's id; repeated rows
of a conversation are turns of their own, ordered by turn, role and text;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table, written

# The control strings.
_NAMES = r"/?(?:INST\]|s>|ROLE[ \]])"
_CONTROL = r"([<\[])(\\*)(" + _NAMES + ")"
_ESCAPED = r"([<\[])\\(\\*)(" + _NAMES + ")"
# A role's name; possessive, so that a long one takes no stack.
_NAME = r"[^\]\\]*+(?:\\.[^\]\\]*+)*+"
_TURN = rf"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE(?: {_NAME})?\].*?\[/ROLE\]"
_ROLE = rf"(?s)^\[ROLE {_NAME}\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def turn(role: Column, text: Column) -> Column:
    """One formatted turn."""
    name = F.concat(F.lit("[ROLE "), F.regexp_replace(role, r"([\]\\])", r"\\$1"), F.lit("]"))
    return (
        F.when(role == "user", F.concat(F.lit("[INST]"), escape(text), F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), escape(text), F.lit("</s>")))
        .otherwise(F.concat(F.coalesce(name, F.lit("[ROLE]")), escape(text), F.lit("[/ROLE]")))
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""

    def one(m: Column) -> Column:
        size = F.length(m)
        head = F.regexp_extract(m, _ROLE, 0)
        named = F.length(head) > 0
        role = F.when(named, F.regexp_replace(head.substr(F.lit(7), F.length(head) - 7), r"(?s)\\(.)", "$1"))
        skip = F.when(named, F.length(head)).otherwise(6)
        return (
            F.when(F.startswith(m, F.lit("[INST]")), F.struct(F.lit("user").alias("role"), unescape(m.substr(F.lit(7), size - 13)).alias("text")))
            .when(F.startswith(m, F.lit("<s>")), F.struct(F.lit("assistant").alias("role"), unescape(m.substr(F.lit(4), size - 7)).alias("text")))
            .otherwise(F.struct(role.alias("role"), unescape(m.substr(skip + 1, size - skip - 7)).alias("text")))
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), one)


def paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths of ``nodes`` (tree, node, parent, score; node unique
    in its tree): rows (tree, leaf, depth, node, rank, branch_score), rank 1
    for the branch of the highest score in its tree."""
    nodes = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    kids = nodes.where("parent is not null").groupBy("tree", F.col("parent").alias("of")).agg(F.count("*").alias("n"))
    up = nodes.select("tree", F.col("node").alias("of"), F.lit(True).alias("there"))
    base = nodes.alias("a").join(kids.alias("k"), F.expr("a.tree <=> k.tree and a.node = k.of"), "left").select("a.*", F.coalesce("k.n", F.lit(0)).alias("kids"))
    base = base.alias("a").join(kids.alias("p"), F.expr("a.tree <=> p.tree and a.parent = p.of"), "left").select("a.*", F.col("p.n").alias("siblings"))
    base = base.alias("a").join(up.alias("u"), F.expr("a.tree <=> u.tree and a.parent = u.of"), "left").select(
        "a.tree", "a.node", F.when(F.col("u.there"), F.col("a.parent")).alias("parent"), "a.score", (F.col("a.kids") == 0).alias("leaf"),
        (F.col("u.there").isNull() | (F.col("a.siblings") != 1)).alias("head"),
    )
    base = written(base, "chat-nodes")

    # runs of only children: pointers double until each has come home to its head
    heads = base.where("head").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.lit(True).alias("there"))
    jump = base.where("not head").join(heads, F.expr("tree <=> t and parent = n"), "left").select(
        "tree", "node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("far"), F.coalesce("there", F.lit(False)).alias("home")
    )
    while True:
        jump = written(jump, "chat-jumps")
        state = jump.agg(F.count_if(~F.col("home")).alias("away"), F.max("far").alias("far"), F.count("*").alias("all")).first()
        if not state["away"] or state["far"] > 2 * state["all"]:  # what is away then lies on a cycle
            break
        ahead = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("home").alias("near"))
        far = jump.where("not home").join(ahead, F.expr("tree <=> t and to = n")).select("tree", "node", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("near").alias("home"))
        jump = far.unionByName(jump.where("home"))
    done = jump.where("home").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("to").alias("run"), F.col("far").alias("place"))
    done = done.unionByName(base.where("head").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("node").alias("run"), F.lit(0).cast("long").alias("place")))
    placed = written(base.join(done, F.expr("tree <=> t and node = n")).drop("t", "n"), "chat-runs")

    # the tree of runs, from the leaves up
    runs = placed.groupBy("tree", "run").agg(F.sum("score").alias("score"), F.max(F.when(F.col("leaf"), F.col("node"))).alias("leaf"), F.count("*").alias("size"), F.max(F.when(F.col("head"), F.col("parent"))).alias("above"))
    to = placed.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("run").alias("above_run"))
    runs = written(runs.join(to, F.expr("tree <=> t and above = n"), "left").drop("t", "n", "above"), "chat-tree")
    # from the roots down: runs on or below a circle of parents are not reached and have no path
    level = written(_levels(runs), "chat-levels")
    reached = level.select(F.col("tree").alias("t"), F.col("run").alias("r"))
    runs = written(runs.join(reached, F.expr("tree <=> t and run = r")).drop("t", "r"), "chat-reached")
    front = runs.where("leaf is not null").select("tree", "leaf", "run", "score", "size", "above_run")
    found = front
    while not front.where("above_run is not null").isEmpty():
        over = runs.select(F.col("tree").alias("t"), F.col("run").alias("r"), F.col("score").alias("s"), F.col("size").alias("z"), F.col("above_run").alias("a"))
        front = written(front.where("above_run is not null").join(over, F.expr("tree <=> t and above_run = r")).select("tree", "leaf", F.col("r").alias("run"), F.col("s").alias("score"), F.col("z").alias("size"), F.col("a").alias("above_run")), "chat-front")
        found = found.unionByName(front.select(found.columns))
    totals = found.groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")))
    above = level.select(F.col("tree").alias("t"), F.col("run").alias("r"), "before")
    placed_runs = found.select("tree", "leaf", "run").join(above, F.expr("tree <=> t and run = r")).drop("t", "r")
    steps = placed_runs.join(ranked.withColumnsRenamed({"tree": "t", "leaf": "l"}), F.expr("tree <=> t and leaf = l")).drop("t", "l")
    spots = placed.select(F.col("tree").alias("t"), F.col("run").alias("r"), "node", "place")
    return steps.join(spots, F.expr("tree <=> t and run = r")).select("tree", "leaf", (F.col("before") + F.col("place")).alias("depth"), "node", "rank", "branch_score")


def _levels(runs: DataFrame) -> DataFrame:
    """For each run below a root the number of messages above it."""
    now = runs.where("above_run is null").select("tree", "run", F.lit(0).cast("long").alias("before"), "size")
    every = now
    below = runs.where("above_run is not null").select(F.col("tree").alias("t"), F.col("run").alias("r"), F.col("size").alias("z"), "above_run")
    more = not below.isEmpty()
    while more:
        now = written(now.join(below, F.expr("tree <=> t and run = above_run")).select("tree", F.col("r").alias("run"), (F.col("before") + F.col("size")).alias("before"), F.col("z").alias("size")), "chat-depth")
        every = every.unionByName(now)
        more = not now.isEmpty()
    return every.select("tree", "run", "before")


def format_trees(messages: DataFrame) -> DataFrame:
    """``messages`` (tree, node, parent, role, text, score) as one row per
    root-to-leaf path: tree, leaf, rank, branch_score, formatted."""
    way = paths(messages)
    said = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), turn(F.col("role"), F.col("text")).alias("said"))
    turns = way.join(said, F.expr("tree <=> t and node = n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "said"))), lambda x: x["said"]), "")
    return turns.groupBy("tree", "leaf", "rank", "branch_score").agg(whole.alias("formatted"))


def chains(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Plain conversations as trees: each row replies to the row before it."""
    cut = rows.select(F.col(id_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    cut = cut.withColumn("node", at)
    return cut.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").alias("score"))


# The conversation that the query adds.
PROBE = "select -7L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(PROBE))
    messages = written(chains(rows), "chat-messages")
    done = format_trees(messages).select("tree", "formatted").withColumn("turns", parse(F.col("formatted")))
    said = F.transform("turns", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    return done.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(text, '([<\[])(\\*)(/?(?:INST\]|s>|ROLE[ \]]))', '\1\\\2\3', 'g'))
    + CASE WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7 WHEN role IS NULL THEN 13
      ELSE 14 + length(regexp_replace(role, '([\]\\])', '\\\1', 'g')) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
