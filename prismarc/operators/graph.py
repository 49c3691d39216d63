"""Connected components over link tables, without a driver-side graph."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is set only where none is and the session is a local one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it has to be a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="prismarc-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """``df`` in the session's checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tabled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the session's checkpoint folder: of it only the columns in use are read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node that links reach, for every linked node.

    Each round takes the least root among the neighbours and then the root of that root, so rounds grow with the logarithm of a chain.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    roots = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        better = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "theirs").alias("next"))
        jump = better.join(roots.select(F.col("node").alias("next"), F.col("root").alias("far")), "next", "left").select("node", "old", F.least("next", F.coalesce("far", "next")).alias("root"))
        roots = written(jump)
        if roots.filter("root <> old").isEmpty():
            return roots.select("node", "root")
        roots = roots.select("node", "root")


def representatives(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """Groups of two and more equal keys: key, members, representative (the least id)."""
    return rows.groupBy(key).agg(F.count("*").alias("members"), F.min(id_col).alias("representative")).filter("members > 1")


def _cliques_over(vertex: object, above: dict, below: dict, part: int = 0, parts: int = 1) -> Iterator[list]:
    """Maximal cliques whose least member is ``vertex``: above has its greater neighbours with theirs among them, below its lesser ones likewise.

    Neighbours are bits of whole numbers, so one operation meets two sets of them.  Of ``parts`` calls each takes the
    branches of its own (by their number among those of three members), and together they give every clique once.
    """
    names = sorted(above) + sorted(below)
    bit = {v: 1 << i for i, v in enumerate(names)}
    near = [0] * len(names)
    place = {v: i for i, v in enumerate(names)}
    for sides in (above, below):
        for v, ns in sides.items():
            for u in ns:
                near[place[v]] |= bit[u]
                near[place[u]] |= bit[v]
    branches = 0
    stack = [([vertex], (1 << len(above)) - 1, ((1 << len(names)) - 1) ^ ((1 << len(above)) - 1))]
    while stack:
        held, free, spent = stack.pop()
        if len(held) == 3 or (len(held) < 3 and not free):
            branches += 1
            if branches % parts != part:
                continue
        if not free:
            if not spent:
                yield held
            continue
        pivot, most, rest, full = 0, -1, free | spent, free.bit_count()
        while rest and most < full:
            i = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            if (many := (free & near[i]).bit_count()) > most:
                pivot, most = i, many
        rest = free & ~near[pivot]
        while rest:
            i = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            stack.append((held + [names[i]], free & near[i], spent & near[i]))
            free ^= 1 << i
            spent |= 1 << i


#: Triangles of a vertex to a task that shares its cliques with others, tasks of a vertex at most, members that are given back at once.
SHARED, SHARES, AT_ONCE = 2000, 16, 1 << 20


def cliques(links: DataFrame, a: str, b: str) -> DataFrame:
    """members (sorted): every maximal clique of two nodes or more, once.

    Nodes are ordered by their number of links, then by id, and a clique is found at its first node in that order, from the
    triangles that begin there and those in which the node is the second.  A node has at most as many neighbours after it as
    the root of twice the number of links, however many it has in all, so a hub's links never meet each other.
    """
    e = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = written(e)
    kind = dict(e.dtypes)["u"]
    often = written(e.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").count())
    place = F.struct("count", "n")
    ranked = e.join(often.select(F.col("n").alias("u"), place.alias("ru")), "u").join(often.select(F.col("n").alias("v"), place.alias("rv")), "v")
    first, last = F.least("ru", "rv"), F.greatest("ru", "rv")
    out = written(ranked.select(first["n"].alias("x"), last["n"].alias("p"), last.alias("r")))
    wedges = out.join(out.toDF("x", "q", "s"), "x").filter("r < s").select("x", "p", "q")
    closed = written(wedges.join(out.select(F.col("x").alias("p"), F.col("p").alias("q")), ["p", "q"]).select("x", "p", "q"))
    none = F.lit(None).cast(kind)
    rows = out.select("x", F.lit(0).alias("side"), "p", none.alias("q")).unionByName(closed.select("x", F.lit(0).alias("side"), "p", "q"))
    rows = rows.unionByName(closed.select(F.col("p").alias("x"), F.lit(1).alias("side"), F.col("x").alias("p"), "q"))

    # what comes of a vertex can be far more than its rows: those of many triangles go to several tasks, each for branches of its own
    often = closed.groupBy("x").count().filter(F.col("count") > SHARED).select("x", F.least(F.ceil(F.col("count") / SHARED), F.lit(SHARES)).cast("int").alias("parts"))
    rows = rows.join(often, "x", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    to = pa.list_(to_arrow_type(closed.schema["p"].dataType))

    def local(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        below: dict = {}
        parts = 1
        for batch in batches:
            parts = batch.column("parts")[0].as_py()
            for side, p, q in zip(*(batch.column(c).to_pylist() for c in ("side", "p", "q")), strict=True):
                near = below if side else above
                near.setdefault(p, set())
                if q is not None:
                    near[p].add(q)
                    if not side:
                        above.setdefault(q, set()).add(p)
        found, members = [], 0
        for clique in _cliques_over(key[0].as_py(), above, below, key[1].as_py(), parts) if above else ():
            found.append(sorted(clique))
            members += len(clique)
            if members >= AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(found, to)], names=["members"])
                found, members = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(found, to)], names=["members"])

    # the rows are few bytes for much work: dealt to a stated number of tasks, or adaptive plans put all into one
    many = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(many, "x", "part").groupBy("x", "part").applyInArrow(local, f"members array<{kind}>")


def resolve_aliases(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root, hops, cyclic) for every child: the end of its chain of parents.  A child has one parent.

    Pointers are doubled, so rounds grow with the logarithm of the longest chain.  A chain that takes more hops than there
    are children never ends: such nodes get a null root and hops, and cyclic true.
    """
    at = written(links.select(F.col(child).alias("node"), F.col(parent).alias("root"), F.lit(1).cast("long").alias("hops")))
    limit = at.count()
    while True:
        far = at.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("hops").alias("more"))
        at = written(at.join(far, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("open")))
        if not at.filter(f"open AND hops <= {limit}").limit(1).count():
            ends = F.col("hops") <= limit
            return at.select("node", F.when(ends, F.col("root")).alias("root"), F.when(ends, F.col("hops")).alias("hops"), (~ends).alias("cyclic"))
        at = at.drop("open")


def absorb_sets(members: DataFrame, set_col: str, item_col: str) -> DataFrame:
    """(set id, by): the sets that lie within another one, with the least set id among the largest that hold them.

    Of equal sets (128 bits of hash) the least id holds the others.  The holder of a set of one item is the largest set that
    has the item.  Larger sets meet the others over their rarest item, so a frequent item links only the sets that have no
    rarer one; most of those that can't hold a set are told by a signature of 64 bits, and items are counted for the rest.
    """
    rows = members.select(F.col(set_col).alias("s"), F.col(item_col).alias("x")).filter("s IS NOT NULL AND x IS NOT NULL").repartition("s").distinct()
    bit = F.expr("shiftleft(1L, CAST(pmod(xxhash64(3, x), 64) AS INT))")
    sets = tabled(rows.groupBy("s").agg(F.count("*").cast("int").alias("size"), F.bit_or(bit).alias("sign"), *[F.bit_xor(F.xxhash64(F.lit(k), "x")).alias(f"h{k}") for k in (1, 2)]))
    firsts = sets.groupBy("h1", "h2", "size").agg(F.min("s").alias("first"), F.count("*").alias("many")).filter("many > 1")
    equal = tabled(sets.join(firsts, ["h1", "h2", "size"]).filter("s <> first").select("s", "first"))
    kept = tabled(rows.join(equal.select("s"), "s", "left_anti").join(sets.select("s", "size", "sign"), "s"))
    items = tabled(kept.groupBy("x").agg(F.count("*").alias("often"), F.min(F.struct((-F.col("size")).alias("less"), "s")).alias("top")))
    single = kept.filter("size = 1").join(items, "x").filter("top.s <> s").select("s", F.col("top.s").alias("by"))
    rare = kept.filter("size > 1").select("s", "x").join(items.select("x", "often"), "x").groupBy("s").agg(F.min(F.struct("often", "x")).alias("r")).select("s", "r.x")
    rare = rare.join(sets.select("s", "size", "sign"), "s")
    over = rare.join(kept.filter("size > 2").select(F.col("s").alias("by"), "x", F.col("size").alias("bigger"), F.col("sign").alias("theirs")), "x")
    over = over.filter(F.col("bigger") > F.col("size")).filter(F.col("sign").bitwiseAND(F.bitwise_not("theirs")) == 0).select("s", "by", "size", "bigger")
    shared = over.join(kept.select("s", "x"), "s").join(kept.select(F.col("s").alias("by"), "x"), ["by", "x"]).groupBy("s", "by", "size", "bigger").agg(F.count("*").alias("met"))
    best = shared.filter("met = size").groupBy("s").agg(F.min(F.struct((-F.col("bigger")).alias("less"), "by")).alias("b")).select("s", "b.by")
    holder = tabled(single.unionByName(best))
    others = equal.join(holder.select(F.col("s").alias("first"), "by"), "first", "left").select("s", F.coalesce("by", "first").alias("by"))
    return holder.unionByName(others).select(F.col("s").alias(set_col), "by")


def keep_unmatched(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, kept): walking by id, a row stays unless a row that stays has one of its keys (null keys match none).

    A row that is the least undecided one for all its keys stays; rows that share a key with it go.  Decisions are not
    passed on through rows that go, so this isn't the components' least rows.
    """
    pairs = written(rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)])).alias("p")).select("id", "p.k", "p.v").filter("v IS NOT NULL"))
    decided = rows.select(F.col(id_col).alias("id")).join(pairs.select("id"), "id", "left_anti").withColumn("kept", F.lit(True))
    while pairs.limit(1).count():
        least = pairs.groupBy("k", "v").agg(F.min("id").alias("least"))
        stay = written(pairs.join(least, ["k", "v"]).groupBy("id").agg(F.every(F.col("id") == F.col("least")).alias("kept")).filter("kept"))
        taken = pairs.join(stay.select("id"), "id", "left_semi").select("k", "v").distinct()
        gone = pairs.join(taken, ["k", "v"], "left_semi").select("id").distinct().join(stay, "id", "left_anti").withColumn("kept", F.lit(False))
        closed = written(stay.unionByName(gone))
        decided = decided.unionByName(closed)
        pairs = written(pairs.join(closed, "id", "left_anti"))
    return decided.select(F.col("id").alias(id_col), "kept")
