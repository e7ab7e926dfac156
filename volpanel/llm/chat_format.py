"""Chat formatting over reply trees; DataFrame functions only.

1. **Chains.** Turns with one reply each are contracted to chains by pointer doubling:
   in each self-join every turn's pointer jumps as far again, so a chain of n turns
   takes log2(n) joins of narrow rows.
2. **Paths.** Iterative self-joins of the chains enumerate root-to-leaf paths; there
   are as many rounds as branchings on a path.
3. **Rank.** The paths of a conversation are ranked by mean score (then length, then
   chain numbers); the first ``best`` are kept.
4. **Format.** Each chosen path becomes one conversation. Turns are numbered along the
   path; running sums of their lengths give the loss mask, [start, length) spans of
   code points that cover the texts of the ``learn`` role and nothing else.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed per turn. In roles
and texts a backslash is put into ``<|`` (one more into ``<\\|``, and so on), so no
control string can stand inside; reading back takes one out.

Defined results: null text or role: empty. Turns whose parent is not there start a path.
Turns on a cycle are on no path. Repeated rows are turns of their own (as rows of a table
without parents: in the order of turn, role, text). A null conversation id is one
conversation. Empty table: no rows. Other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.sources.stage import stage

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
NO_ID = -(1 << 63)


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def as_tree(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as a tree (conv, node, parent, role, text, score): each turn answers the one before."""
    by = Window.partitionBy("conv").orderBy("turn", "role", "text")
    return (rows.select(F.coalesce(F.col(conv).cast("long"), F.lit(NO_ID)).alias("conv"), F.col(turn).alias("turn"),
                        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
            .withColumn("node", F.row_number().over(by).cast("long"))
            .select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")))


def chains(tree: DataFrame) -> DataFrame:
    """(conv, node, parent, score, chain, place): chain is its first node, place the distance from it."""
    kids = tree.groupBy("conv", F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    links = (tree.select("conv", "node", "parent", "score").join(kids.withColumnRenamed("node", "parent"), ["conv", "parent"], "left")
             .join(tree.select("conv", F.col("node").alias("parent"), F.lit(1).alias("there")), ["conv", "parent"], "left"))
    inner = (F.col("kids") == 1) & F.col("there").isNotNull()
    now = stage(links.select("conv", "node", "parent", "score", F.when(inner, F.col("parent")).otherwise(F.col("node")).alias("chain"),
                             F.when(inner, 1).otherwise(0).cast("long").alias("place")), "chains")
    n, done = 1, False
    rows = now.count()
    while not done and n <= 2 * rows:
        up = now.select("conv", F.col("node").alias("chain"), F.col("chain").alias("far"), F.col("place").alias("more"))
        now = stage(now.join(up, ["conv", "chain"]).select("conv", "node", "parent", "score", F.col("far").alias("chain"), (F.col("place") + F.col("more")).alias("place"),
                                                           (F.col("more") > 0).alias("moved")), "chains")
        done = now.where("moved").isEmpty()
        now, n = now.drop("moved"), 2 * n
    heads = now.where("place = 0").select("conv", "chain")
    return now.join(heads, ["conv", "chain"], "left_semi")  # the rest is on cycles


def best_paths(nodes: DataFrame, best: int) -> DataFrame:
    """(conv, path, chains): the first ``best`` root-to-leaf paths of each conversation, as arrays of chains."""
    table = nodes.groupBy("conv", "chain").agg(F.sum("score").alias("s"), F.count("*").alias("n"), F.max(F.when(F.col("place") == 0, F.col("parent"))).alias("parent"))
    owner = nodes.select("conv", F.col("node").alias("parent"), F.col("chain").alias("up"))
    table = stage(table.join(owner, ["conv", "parent"], "left").select("conv", "chain", "up", "s", "n"), "chain_table")
    inner = table.where("up is not null").select("conv", F.col("up").alias("chain")).distinct().withColumn("goes_on", F.lit(True))
    table = stage(table.join(inner, ["conv", "chain"], "left"), "chain_table")
    ahead, done = table.where("up is null").select("conv", F.array("chain").alias("chains"), F.col("chain").alias("up"), "s", "n", "goes_on"), []
    while True:
        ahead = stage(ahead, "paths")
        done.append(ahead.where("goes_on is null").drop("goes_on", "up"))
        ahead = ahead.where("goes_on")
        if ahead.isEmpty():
            break
        below = table.select("conv", "up", "chain", F.col("s").alias("s2"), F.col("n").alias("n2"), F.col("goes_on").alias("on2"))
        ahead = ahead.join(below, ["conv", "up"]).select("conv", F.concat("chains", F.array("chain")).alias("chains"), F.col("chain").alias("up"),
                                                         (F.col("s") + F.col("s2")).alias("s"), (F.col("n") + F.col("n2")).alias("n"), F.col("on2").alias("goes_on"))
    paths = done[0]
    for d in done[1:]:
        paths = paths.union(d)
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc(F.col("s") / F.col("n")), F.desc("n"), "chains"))
    return paths.withColumn("path", rank).where(F.col("path") <= best).select("conv", "path", "chains")


def format_trees(tree: DataFrame, best: int = 1, learn: str = "assistant") -> DataFrame:
    """``tree``: (conv, node, parent, role, text, score). One row per chosen path: conv_id, path (its rank),
    formatted, and spans, the loss mask."""
    tree = stage(tree, "tree")
    nodes = stage(chains(tree), "nodes")
    chosen = best_paths(nodes, best).select("conv", "path", F.posexplode("chains").alias("step", "chain"))
    at = nodes.select("conv", "chain", "place", "node").join(chosen, ["conv", "chain"]).select("conv", "path", "step", "place", "node")
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    turns = (tree.select("conv", "node", "role", head.alias("head"), escape(F.col("text")).alias("body")).join(at, ["conv", "node"])
             .withColumn("block", F.concat("head", "body", F.lit(END))))
    order = Window.partitionBy("conv", "path").orderBy("step", "place")
    before = F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("block")
    span = F.when(F.col("role") == learn, F.struct((before + F.length("head")).alias("start"), F.length("body").cast("long").alias("len")))
    packed = (turns.select("conv", "path", F.struct("step", "place", "block", span.alias("span")).alias("t")).groupBy("conv", "path")
              .agg(F.array_sort(F.collect_list("t")).alias("ts")))
    return packed.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "path", F.array_join("ts.block", "").alias("formatted"),
                         F.filter("ts.span", lambda s: s.isNotNull()).alias("spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """The columns of query op4, from the formatted text and its mask alone."""
    blocks = F.filter(F.split("formatted", END.replace("|", r"\|")), lambda b: b != "")
    inner = r"(?s)^<\|im_start\|>(.*?)<\|im_sep\|>(.*)$"
    turns = F.transform("blocks", lambda b: F.concat(unescape(F.regexp_extract(b, inner, 1)), F.lit("\n"), unescape(F.regexp_extract(b, inner, 2)), F.lit("\n")))
    loss = F.transform("spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["len"])))
    return (chats.withColumn("blocks", blocks).withColumn("loss", F.array_join(loss, ""))
            .select("conv_id", F.size("blocks").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
