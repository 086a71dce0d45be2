"""Chat formatting of reply trees, in DataFrame operations only.

Messages (conversation, node, parent, role, text, score) form trees.  A branch
is the path from a root to a leaf; its score is the sum of its messages' scores.
Iterative self-joins double a jump table (each message's ancestor 1, 2, 4, ...
steps up), so paths of length n need log2(n) joins: going up they sum scores and
lengths, coming down they split each chosen leaf's path into its messages, whose
number is all that is ever made.  Branches are ranked within a conversation by
score (ties: smaller leaf), and the first ``branches`` are formatted.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside roles
and texts a backslash is doubled, ``<|`` becomes ``<\\|`` and, in roles, a line
break becomes ``<\\n``; reading undoes this, so texts may hold any control string.
The loss mask is the list of (start, length), in code points of the formatted
string, of the texts of ``assistant`` turns.

Defined results: a null text or role counts as empty; a message whose parent is
unknown is a root; messages that reach no root (cycles) belong to no branch; a
null score counts as 0; messages of a null conversation are one conversation; a message
of a null node belongs to no branch and drops no other; an empty table gives an
empty result.  Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A

START, END, ASSISTANT = "<|im_start|>", "<|im_end|>\n", "assistant"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(c, F.lit("\n"), F.lit("<\\n")) if role else c


def unescape(c: Column, role: bool = False) -> Column:
    if role:
        c = F.replace(c, F.lit("<\\n"), F.lit("\n"))
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def chains(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages of plain conversations as trees without branches: each replies to the one before it."""
    own = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), role, text)
    return messages.select(F.col(conv).alias("conv"), F.row_number().over(own).cast("long").alias("node"), F.col(role).alias("role"), F.col(text).alias("text")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def _held(conv: str) -> Column:
    """A conversation's key as a struct, which is never null, so that joins match a null key too."""
    return F.struct(F.col(conv).alias("conv")).alias("conv")


def branch_messages(tree: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, branch, place, node): the messages of the chosen branches, root first."""
    nodes = tree.select(_held("conv"), "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("known"))
    up = nodes.join(known, ["conv", "parent"], "left").select("conv", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("steps"))
    leaves = nodes.select("conv", "node").join(nodes.select("conv", F.col("parent").alias("node")), ["conv", "node"], "left_anti")
    steps = A.table(up, "jump")
    going, ended = steps.filter("up is not null"), steps.filter("up is null")
    # level k has the messages with an ancestor 2**k steps up; the sums of the others have reached a root
    jumps = [going]
    size = steps.count()
    while 1 << (len(jumps) - 1) <= size and going.limit(1).count():  # what is left after that is a cycle
        b = going.unionByName(ended).select("conv", F.col("node").alias("up"), F.col("up").alias("further"), F.col("score").alias("more"), F.col("steps").alias("longer"))
        steps = A.table(going.join(b, ["conv", "up"]).select("conv", "node", F.col("further").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("steps") + F.col("longer")).alias("steps")), "jump")
        going, ended = steps.filter("up is not null"), ended.unionByName(steps.filter("up is null"))
        jumps.append(going)
    total = ended.select("conv", "node", "score", "steps")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "node"))
    chosen = leaves.join(total, ["conv", "node"]).withColumn("branch", rank).filter(F.col("branch") <= branches)
    # halve each path down to single messages: a part goes up `steps` messages from `node`, `below` messages above its leaf
    part = A.table(chosen.select("conv", "branch", "node", "steps", F.lit(0).cast("long").alias("below"), F.col("steps").alias("all")), "part")
    for k in range(len(jumps) - 1, -1, -1):
        half = 1 << k
        far = jumps[k].select("conv", "node", F.col("up").alias("far"))
        wide = part.filter(F.col("steps") > half).join(far, ["conv", "node"])
        both = F.array(F.struct(F.col("node").alias("node"), F.lit(half).cast("long").alias("steps"), F.col("below").alias("below")), F.struct(F.col("far").alias("node"), (F.col("steps") - half).alias("steps"), (F.col("below") + half).alias("below")))
        part = A.table(part.filter(F.col("steps") <= half).unionByName(wide.select("conv", "branch", "all", F.explode(both).alias("p")).select("conv", "branch", "all", "p.*")), "part")
    return part.select("conv.conv", "branch", (F.col("all") - F.col("below") - 1).alias("place"), "node")


def format_tree(tree: DataFrame, branches: int = 1) -> DataFrame:
    """conv, branch, formatted (string) and loss (array<struct<start,length>>) of each chosen branch."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    said = tree.select(_held("conv"), "node", (role == ASSISTANT).alias("learn"), F.concat(F.lit(START), escape(role, True), F.lit("\n")).alias("head"), escape(text).alias("body"))
    with A.Scope() as scope:
        chosen = scope.keep(A.table(branch_messages(tree, branches), "branches"))
    turns = chosen.withColumn("conv", _held("conv")).join(said, ["conv", "node"])
    # positions by lengths before the text is gathered
    length = F.char_length("head") + F.char_length("body") + len(END)
    before = F.sum(length).over(Window.partitionBy("conv", "branch").orderBy("place")) - length
    turns = turns.withColumn("start", (before + F.char_length("head")).cast("long"))
    span = F.when(F.col("learn"), F.struct("start", F.char_length("body").cast("long").alias("length")))
    got = turns.groupBy("conv", "branch").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span")))).alias("t"))
    return got.select("conv.conv", "branch", F.array_join(F.col("t.turn"), "").alias("formatted"), F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns, array<struct<role,text>>, of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p):
        p = F.substring(p, F.lit(len(START) + 1), F.char_length(p))
        head = F.substring_index(p, "\n", 1)
        return F.struct(unescape(head, True).alias("role"), unescape(F.substring(p, F.char_length(head) + 2, F.char_length(p))).alias("text"))

    return F.transform(parts, turn)


def learned(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
