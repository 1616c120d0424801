"""The prefix trie of conversations, and subtree totals by parallel tree contraction.

**Nodes.**  A turn of a conversation is hashed together with its place; a prefix is the
exclusive or of its turns' hashes (128 bits, two texts are the same where these are), so
prefixes come from sums over blocks of turns and a conversation of any length is spread
over tasks.  Equal prefixes are one node; counts and minima are combined before the
shuffle.

**Contraction.**  Every round has two steps on the tree that is left.  *Rake*: all leaves
give what they hold to their parents and go; what a leaf holds then is its subtree's
total.  *Compress*: of the nodes with one child left, those that a hash of the round puts
before both neighbours in their chain are taken out: the child gets the grandparent as
its parent and a load that it will pass on besides its own total.  A node taken out has
its child's total plus a known difference.  Leaves go at once and chains shrink by a
third in each round, so the rounds are logarithmic in the size of the tree.

**Expansion.**  The rounds are undone from the last to the first: a node that was taken
out gets its child's total, known by then, plus the difference.

Each round's tree is a table in the shared folder, and so is what it took out.
"""

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.llm.frames import ship, stored

_TURNS = 2_000


# -- turns in order ----------------------------------------------------------------------

def _spread(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows sorted by group and order over range partitions, each with its partition ``part``, stored."""
    return stored(rows.repartitionByRange(F.col("grp"), *order).withColumn("part", F.spark_partition_id()), "ranged")


def _before(parts: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Each (group, part) with what the earlier parts of the group add up to."""
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "part", *[c.over(earlier).alias(n) for n, c in sums.items()])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` to ``(conv_id, at, role, text)``: turns counted from 0.

    Null turns come first; equal turns go by role, then by text.  The rows are dealt by
    range, so a conversation of very many turns is in many partitions; a partition counts
    its own rows and adds what the earlier ones hold.
    """
    told = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("grp"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the order of equal turns is that of hashes where rows are dealt, of the texts inside a partition:
    # all rows of one turn of a conversation are dealt to one partition
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = _spread(told, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    inside = Window.partitionBy("grp", "part").orderBy(*order)
    counts = ranged.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"))
    first = _before(counts, ["grp"], {"first": F.sum("rows")})
    ranked = ranged.withColumn("nth", F.row_number().over(inside) - 1)
    return ranked.join(first, ["grp", "part"]).select(
        F.col("grp").alias("conv_id"), (F.coalesce("first", F.lit(0)) + F.col("nth")).alias("at"), "role", "text")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(conversations, turns)``: ids, and ``(conv_id, d, role, text)`` with places from 1.

    The first h turns are those of conversation ``conv_id - conv_id % every``, the others
    the conversation's own after its first h; h is the CRC-32 of the id's digits modulo
    ``most``.
    """
    own = stored(numbered_turns(turns), "turns")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % F.lit(every)
    convs = sizes.select("conv_id", h.alias("h"), base.alias("base"))
    heads = own.where(F.col("at") < most - 1).select(F.col("conv_id").alias("base"), "at", "role", "text")
    given = convs.join(heads, "base").where("at < h")
    # a base with fewer than h turns gives all it has
    held = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    convs = convs.join(held, "base", "left").withColumn("g", F.least("h", F.coalesce("has", F.lit(0))))
    rest = own.join(convs.select("conv_id", "h", "g"), "conv_id").where("at >= h").select(
        "conv_id", (F.col("g") + F.col("at") - F.col("h") + 1).alias("d"), "role", "text")
    all_ = given.select("conv_id", (F.col("at") + 1).alias("d"), "role", "text").unionByName(rest)
    return stored(convs.select("conv_id"), "conversations"), all_


# -- nodes -------------------------------------------------------------------------------

def _prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, d, k1, k2, p1, p2, chars)``: the hash of each prefix and of the one before it."""
    hashed = turns.select(
        "conv_id", "d", F.length("text").cast("long").alias("chars"),
        F.xxhash64(F.lit(1), "d", F.length("role"), "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), "d", F.length("role"), "role", "text").alias("h2"),
        F.floor((F.col("d") - 1) / _TURNS).alias("part"))
    hashed = stored(hashed, "hashes")
    parts = hashed.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    first = _before(parts, ["conv_id"], {"b1": F.bit_xor("x1"), "b2": F.bit_xor("x2")})
    so_far = Window.partitionBy("conv_id", "part").orderBy("d")
    inside = hashed.select("*", F.bit_xor("h1").over(so_far).alias("x1"), F.bit_xor("h2").over(so_far).alias("x2"))
    k = {i: F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)}
    return inside.join(first, ["conv_id", "part"]).select(
        "conv_id", "d", k[1].alias("k1"), k[2].alias("k2"), k[1].bitwiseXOR(F.col("h1")).alias("p1"),
        k[2].bitwiseXOR(F.col("h2")).alias("p2"), "chars")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of joined ids to one digest a node; nothing but the digest is held."""
    now, running = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([running.hexdigest()])], ["id", "ends"])

    for b in batches:
        for node, piece in zip(b.column("id").to_pylist(), b.column("piece").to_pylist(), strict=True):
            if node != now:
                if running is not None:
                    yield done()
                now, running = node, sha256(piece.encode())
            else:
                running.update(("," + piece).encode())
    if running is not None:
        yield done()


def _ends(last: DataFrame) -> DataFrame:
    """``(id, conv_id)`` to ``(id, ends)``: the digest of the sorted ids, joined by commas.

    Ids are sorted and joined in ranges of their own; only the joined pieces of a node,
    a few for thousands of ids, come together, and they are read one after the other.
    """
    ranged = _spread(last.select(F.col("id").alias("grp"), "conv_id"), [F.col("conv_id")])
    pieces = ranged.groupBy("grp", "part").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(F.col("grp").alias("id"), "part",
                           F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("piece"))
    dealt = pieces.repartition("id").sortWithinPartitions("id", "part")
    return dealt.select("id", "piece").mapInArrow(_digest, "id long, ends string")


# -- contraction -------------------------------------------------------------------------

def _rake(tree: DataFrame, sums: list[str]) -> DataFrame:
    """The tree without its leaves; parents have what these held."""
    given = tree.where("kids = 0 and parent is not null").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("gone"), *[F.sum(F.col(s) + F.col(f"{s}_load")).alias(f"{s}_got") for s in sums])
    left = tree.where("kids > 0 or parent is null").join(given, "id", "left")
    return left.select(
        "id", "parent", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"),
        *[(F.col(s) + F.coalesce(f"{s}_got", F.lit(0))).alias(s) for s in sums], *[f"{s}_load" for s in sums])


def _taken_out(tree: DataFrame, sums: list[str], turn: int) -> DataFrame:
    """``(id, child, parent, <sum>_more)``: nodes of chains, no two next to each other.

    ``<sum>_more`` is what the node's total has more than its child's.
    """
    chain = tree.where("kids = 1 and parent is not null")
    above = chain.select(F.col("id"), F.col("parent").alias("up"), *[F.col(s).alias(f"{s}_own") for s in sums],
                         *[F.col(f"{s}_load").alias(f"{s}_own_load") for s in sums])
    below = tree.where("parent is not null").select(
        F.col("id").alias("child"), F.col("parent").alias("id"),
        ((F.col("kids") == 1)).alias("chained"), *[F.col(f"{s}_load") for s in sums])
    pairs = above.join(below, "id")
    pairs = pairs.withColumn("mine", F.xxhash64(F.lit(turn), "id")).withColumn("next", F.xxhash64(F.lit(turn), "child"))
    before = (F.col("mine") < F.col("next")) | ((F.col("mine") == F.col("next")) & (F.col("id") < F.col("child")))
    # a node waits for its parent where that comes before it
    waits = pairs.where(F.col("chained") & before).select(F.col("child").alias("id"))
    chosen = pairs.where(~F.col("chained") | before).join(waits, "id", "left_anti")
    return stored(chosen.select(
        "id", "child", F.col("up").alias("parent"), *[(F.col(f"{s}_load") + F.col(f"{s}_own")).alias(f"{s}_more") for s in sums],
        *[(F.col(f"{s}_own") + F.col(f"{s}_own_load")).alias(f"{s}_pass") for s in sums]), "taken-out")


def _compress(tree: DataFrame, out: DataFrame, sums: list[str]) -> DataFrame:
    """The tree without the nodes taken out; their children hang one higher."""
    moved = out.select(F.col("child").alias("id"), F.col("parent").alias("up"), *[f"{s}_pass" for s in sums])
    left = tree.join(out.select("id"), "id", "left_anti").join(moved, "id", "left")
    return left.select(
        "id", F.coalesce("up", "parent").alias("parent"), "kids", *sums,
        *[(F.col(f"{s}_load") + F.coalesce(f"{s}_pass", F.lit(0))).alias(f"{s}_load") for s in sums])


def subtree_totals(nodes: DataFrame, sums: list[str], rounds: int = 500) -> DataFrame:
    """``(id long, parent long, sums...)`` of a forest to ``(id, sums...)`` added over subtrees.

    Roots have no parent.  Raises if ``rounds`` are not enough, which a cycle would do.
    """
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    tree = nodes.join(kids, "id", "left").select(
        "id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *[F.col(s).cast("long").alias(s) for s in sums],
        *[F.lit(0).cast("long").alias(f"{s}_load") for s in sums])
    tree = stored(tree, "tree")
    history = []
    for turn in range(rounds):
        if tree.where("parent is not null").isEmpty():
            break
        raked = stored(_rake(tree, sums), "raked")
        out = _taken_out(raked, sums, turn)
        history.append((tree, out))
        tree = stored(_compress(raked, out, sums), "tree")
    else:
        raise RuntimeError(f"subtree_totals: nodes left after {rounds} rounds")
    known = tree.select("id", *sums)
    for before, out in reversed(history):
        # what this round left has its totals; its own nodes that went out take their children's
        back = out.join(known.withColumnRenamed("id", "child"), "child").select(
            "id", *[(F.col(s) + F.col(f"{s}_more")).alias(s) for s in sums])
        leaves = before.where("kids = 0 and parent is not null").select("id", *sums)
        known = stored(known.unionByName(back).unionByName(leaves), "totals")
    return known


# -- operator ----------------------------------------------------------------------------

def conversation_trie(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one included.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.  Null roles and texts
    are empty; rows without a conversation id take no part; repeated rows are turns of
    their own.  An empty table has no conversation and gives no row.  Other columns are
    not looked at.
    """
    ship(turns.sparkSession)
    convs, told = rebuilt(turns, every, most)
    rows = stored(_prefixes(told), "prefixes")
    found = rows.groupBy(F.col("d").alias("depth"), "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = found.select(F.col("depth").cast("long").alias("depth"), *root.columns[1:]).unionByName(root)
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                      F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    placed = stored(nodes.join(up, ["depth", "p1", "p2"], "left"), "placed")
    kids = placed.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    placed = stored(placed.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "placed")
    totals = subtree_totals(placed.select(
        "id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    # the node at which each conversation ends: its last prefix, or the root
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("d", "k1", "k2"), "d").alias("x"))
    ended = convs.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("x.d", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("x.k1", F.lit(0)).alias("k1"), F.coalesce("x.k2", F.lit(0)).alias("k2"))
    ends = _ends(ended.join(placed.select("id", "depth", "k1", "k2"), ["depth", "k1", "k2"]).select("id", "conv_id"))
    return (placed.join(totals, "id").join(ends, "id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


ORACLE = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM own),
bits AS (
  SELECT conv_id, list_transform(range(0, 8 * length(conv_id::VARCHAR)),
    lambda i: (ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1) AS b
  FROM ids),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)),
    lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END),
    4294967295::BIGINT) % 6 AS h
  FROM bits),
given AS (
  SELECT c.conv_id, o.pos AS pos, o.role, o.text
  FROM crc c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos < c.h),
told AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY kind, pos) AS d, role, text
  FROM (SELECT conv_id, 0 AS kind, pos, role, text FROM given
        UNION ALL SELECT o.conv_id, 1, o.pos, o.role, o.text FROM own o JOIN crc c USING (conv_id) WHERE o.pos >= c.h)),
keyed AS (
  SELECT conv_id, d, length(text) AS chars,
    string_agg(md5(role) || md5(text), '' ) OVER (PARTITION BY conv_id ORDER BY d) AS k
  FROM told),
rows_ AS (
  SELECT conv_id, d, k, chars FROM keyed UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM rows_ GROUP BY k, d),
kids AS (SELECT left(k, -64) AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
shaped AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k, d)),
totals AS (
  SELECT a.k, sum((b.n_children = 0)::BIGINT) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved
  FROM shaped a JOIN shaped b ON b.d >= a.d AND starts_with(b.k, a.k) GROUP BY a.k),
ended AS (
  SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(k, d) AS k FROM rows_ GROUP BY conv_id) GROUP BY k)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  n.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM shaped n LEFT JOIN shaped p ON n.d > 0 AND p.k = left(n.k, -64) AND p.d = n.d - 1
JOIN totals t ON t.k = n.k LEFT JOIN ended e ON e.k = n.k
"""
