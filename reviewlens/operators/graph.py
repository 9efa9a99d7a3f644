"""Code graph: building, neighbours, impact, shortest path, statistics, a small query language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import node_label
from reviewlens.operators.facts import call_targets, first_of, indexes, of_kind

# Fixed values.
NODE_TYPES = ("FILE", "CLASS", "METHOD", "INTERFACE")
EDGE_TYPES = ("CALLS", "IMPLEMENTS", "EXTENDS", "IMPORTS", "CONTAINS")


def build(facts: DataFrame, exact_imports: bool = False) -> tuple[DataFrame, DataFrame]:
    """GR1: ``nodes`` (id, type, name, file_path, class_name) and ``edges`` (src, dst, type, line) of a project's facts.

    Ids carry the path, so same-named classes stay apart. Calls go to a method of the caller's class,
    else of the resolved target file, else to the first method of that name by (path, place); parents
    and interfaces to one of the same file, else a class, else an interface. ``exact_imports``: an
    import names a file only where the whole path is equal; else its end suffices.
    """
    types, methods = of_kind(facts, "type"), of_kind(facts, "method")
    class_id = lambda p, n: F.concat(F.lit("class:"), p, F.lit(":"), n)
    method_id = F.concat(F.lit("method:"), "file_path", F.lit(":"), "owner", F.lit("."), "name", F.lit("("), F.array_join("names", ","), F.lit(")"))
    files = facts.select("file_path").distinct()
    file_nodes = files.select(F.concat(F.lit("file:"), "file_path").alias("id"), F.lit("FILE").alias("type"), F.element_at(F.split("file_path", "/"), -1).alias("name"), "file_path", F.lit(None).cast("string").alias("class_name"), F.lit(0).alias("ord"))
    type_nodes = types.select(class_id(F.col("file_path"), F.col("name")).alias("id"), F.when(F.col("type") == "interface", "INTERFACE").otherwise("CLASS").alias("type"), "name", "file_path", F.col("name").alias("class_name"), "ord")
    method_nodes = methods.select(method_id.alias("id"), F.lit("METHOD").alias("type"), "name", "file_path", F.col("owner").alias("class_name"), "ord")
    nodes = file_nodes.unionByName(type_nodes).unionByName(method_nodes)

    edge = lambda s, d, t, line=None: [s.alias("src"), d.alias("dst"), F.lit(t).alias("type"), (F.lit(-1) if line is None else F.col(line)).alias("line")]
    holds = types.select(*edge(F.concat(F.lit("file:"), "file_path"), class_id(F.col("file_path"), F.col("name")), "CONTAINS"))
    holds = holds.unionByName(methods.select(*edge(class_id(F.col("file_path"), F.col("owner")), method_id, "CONTAINS")))

    parents = types.where("detail != ''").select("file_path", "name", F.col("detail").alias("up"), F.lit("EXTENDS").alias("kind"), "ord")
    parents = parents.unionByName(types.select("file_path", "name", F.explode("names").alias("up"), F.lit("IMPLEMENTS").alias("kind"), "ord"))
    candidates = type_nodes.select(F.col("id").alias("dst"), F.col("type").alias("node_type"), F.col("name").alias("up"), F.col("file_path").alias("path"), F.col("ord").alias("at"))
    tied = parents.join(candidates, "up")
    tied = first_of(tied, ["file_path", "name", "up", "kind"], [F.col("path") != F.col("file_path"), F.col("node_type") != "CLASS", "path", "at"])
    inherits = tied.select(class_id(F.col("file_path"), F.col("name")).alias("src"), "dst", F.col("kind").alias("type"), F.lit(-1).alias("line"))

    calls = call_targets(facts)
    own = of_kind(facts, "call").select("file_path", "ord", F.col("names")[0].alias("signature"))
    calls = calls.join(own, ["file_path", "ord"])
    to = method_nodes.select(F.col("id").alias("dst"), F.col("name").alias("callee"), F.col("file_path").alias("path"), F.col("class_name").alias("in_class"), F.col("ord").alias("at"))
    found = calls.join(to, "callee")
    inside = (F.col("path") == F.col("file_path")) & (F.col("in_class") == F.col("caller_class")) & F.col("scope").isin("", "this")
    found = first_of(found, ["file_path", "ord"], [~inside, F.coalesce(F.col("path") != F.col("target_path"), F.lit(True)), "path", "at"])
    called = found.select(*edge(F.concat(F.lit("method:"), "file_path", F.lit(":"), "caller_class", F.lit("."), "signature"), F.col("dst"), "CALLS", "line"))

    wanted = of_kind(facts, "import").select("file_path", F.concat(F.replace(F.col("name"), F.lit("."), F.lit("/")), F.lit(".java")).alias("want"))
    have = files.select(F.col("file_path").alias("target"))
    tail = F.element_at(F.split("want", "/"), -1)
    # the file name is the join key; the rest of the path is compared within it
    near = wanted.withColumn("base", tail).join(have.withColumn("base", F.element_at(F.split("target", "/"), -1)), "base")
    fits = F.col("target") == F.col("want")
    near = near.where(fits if exact_imports else fits | F.col("target").endswith(F.concat(F.lit("/"), "want")))
    imports = near.select(*edge(F.concat(F.lit("file:"), "file_path"), F.concat(F.lit("file:"), "target"), "IMPORTS"))
    return nodes, holds.unionByName(inherits).unionByName(called).unionByName(imports)


def neighbours(edges: DataFrame, nodes: DataFrame, ident: str, relation: str) -> DataFrame:
    """GR2, JN3: the nodes at the other end of one node's edges; dangling edges drop."""
    back, kind = {
        "callers": (True, "CALLS"),
        "callees": (False, "CALLS"),
        "implementations": (True, "IMPLEMENTS"),
        "parent": (False, "EXTENDS"),
        "subclasses": (True, "EXTENDS"),
        "members": (False, "CONTAINS"),
    }[relation]
    near, far = ("dst", "src") if back else ("src", "dst")
    ids = edges.where((F.col("type") == kind) & (F.col(near) == ident)).select(F.col(far).alias("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def dependents(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """GR3, U2: the different sources of edges into the seeds (``id``), CONTAINS aside."""
    return edges.where("type != 'CONTAINS'").join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def dependencies(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """GR3."""
    return edges.where("type != 'CONTAINS'").join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def impact(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """GR4, U3: what reaches the seeds in at most ``depth`` steps back, CONTAINS aside, with its distance; without the seeds.

    Level by level: the frontier's sources, less all visited. Each level is one semi-join and one
    anti-join; the visited set is cut from its lineage in the shared folder where there is one.
    """
    seen = seeds.select("id", F.lit(0).alias("depth"))
    frontier = seeds.select("id")
    for d in range(1, depth + 1):
        frontier = _cut(dependents(edges, frontier).join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier.select("id", F.lit(d).alias("depth")))
    return seen.where("depth > 0")


def impact_of_many(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """GR4, U2, U3 for many seeds in one search: (``seed``, ``id``, ``depth``) of what reaches each seed in at most ``depth`` steps back, CONTAINS aside.

    Seeds (``id``) are numbered; 64 share a word, in which each has a bit. A level joins the frontier's
    words with the edges once, whatever the number of seeds, merges them with ``bit_or`` before and after
    the shuffle, and takes away the bits that were seen; the new bits are the level's result.
    """
    spark = edges.sparkSession
    # numbers of one partition follow each other, so words are full but for the last of each
    numbered = seeds.select(F.col("id").alias("seed")).distinct().withColumn("number", F.monotonically_increasing_id())
    numbered = _cut(numbered.select("seed", F.shiftright("number", 6).alias("word"), (F.col("number") % 64).cast("int").alias("bit")))
    back = _cut(edges.where("type != 'CONTAINS'").select("src", "dst").distinct())
    level = numbered.groupBy(F.col("seed").alias("id"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    seen, out = level, []
    for d in range(1, depth + 1):
        reached = back.join(level.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "word").agg(F.bit_or("bits").alias("bits"))
        old = seen.withColumnRenamed("bits", "old")
        level = reached.join(old, ["id", "word"], "left").select("id", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits")).where("bits != 0")
        level = _cut(level)
        out.append(level.withColumn("depth", F.lit(d)))
        seen = _cut(seen.unionByName(level).groupBy("id", "word").agg(F.bit_or("bits").alias("bits")))
    if not out:
        return spark.createDataFrame([], "seed string, id string, depth int")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    # a word's seeds: at most 64 rows for each of its bits
    return every.join(numbered, "word").where(F.expr("shiftright(bits, bit) & 1L") == 1).select("seed", "id", "depth")


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """GR5: the edges of a shortest path over all types, in order; no rows where there is none.

    Of all shortest paths the one whose nodes, read from the start, come first. The search goes on from both
    ends, always by the smaller frontier, so each end goes about half of the levels and meets far fewer
    nodes; a level is one join and one aggregate, cut from its lineage, and its size decides what is next.
    Where the frontiers share nodes, these are traced back to the start, level by level, by semi-joins; the
    path itself is then one node a step, looked up in what was traced or, past the meeting, in the goal's levels.
    """
    spark = edges.sparkSession
    schema = "step int, src string, dst string, type string, line int"
    if start == goal:
        return spark.createDataFrame([], schema)
    step = _cut(edges.groupBy("src", "dst").agg(F.min(F.struct("type", "line")).alias("e")))
    levels = [[spark.createDataFrame([(x,)], "id string")] for x in (start, goal)]
    seen, sizes, met = [levels[0][0], levels[1][0]], [1, 1], None
    while met is None:
        side = 0 if sizes[0] <= sizes[1] else 1
        near, far = ("src", "dst") if side == 0 else ("dst", "src")
        out = step.join(levels[side][-1].withColumnRenamed("id", near), near, "left_semi").select(F.col(far).alias("id")).distinct()
        level = _cut(out.join(seen[side], "id", "left_anti"))
        sizes[side] = level.count()
        if not sizes[side]:
            return spark.createDataFrame([], schema)
        levels[side].append(level)
        seen[side] = _cut(seen[side].unionByName(level)) if len(levels[side]) % 8 == 0 else seen[side].unionByName(level)
        both = level.join(levels[1 - side][-1], "id", "left_semi")
        if both.limit(1).count():
            met = _cut(both)
    # the meeting's nodes, and of the start's levels those that lead to them
    ahead = [met]
    for level in reversed(levels[0][1:-1]):
        onto = step.join(ahead[0].withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        ahead.insert(0, _cut(level.join(onto, "id", "left_semi")))
    ways, path, at = [*ahead, *reversed(levels[1][:-1])], [], start
    if len(levels[0]) == 1:
        ways = list(reversed(levels[1][:-1]))
    for k, way in enumerate(ways):
        r = step.where(F.col("src") == at).join(way.withColumnRenamed("id", "dst"), "dst", "left_semi").orderBy("dst").first()
        path.append((k, at, r["dst"], r["e"]["type"], r["e"]["line"]))
        at = r["dst"]
    return spark.createDataFrame(path, schema)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG12: counts of different nodes and of edges, in all and for every type, found or not."""
    spark = nodes.sparkSession
    every = spark.createDataFrame([("node", t) for t in NODE_TYPES] + [("edge", t) for t in EDGE_TYPES], "kind string, type string")
    n = nodes.dropDuplicates(["id"]).groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
    e = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge"))
    each = every.join(n.unionByName(e), ["kind", "type"], "left").select("kind", "type", F.coalesce("n", F.lit(0)).alias("n"))
    return each.unionByName(each.groupBy("kind").agg(F.lit("*").alias("type"), F.sum("n").alias("n")).select("kind", "type", "n"))


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK7: the lines of a Mermaid graph, without CONTAINS, for a text sink; ordered by (part, line)."""
    shape = F.when(F.col("type") == "FILE", F.concat(F.lit("(["), "name", F.lit("])"))).when(F.col("type") == "INTERFACE", F.concat(F.lit("[["), "name", F.lit("]]"))).when(F.col("type") == "METHOD", F.concat(F.lit("("), "name", F.lit(")"))).otherwise(F.concat(F.lit("["), "name", F.lit("]")))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), node_label(F.col("id")), shape).alias("line"))
    e = edges.where("type != 'CONTAINS'").select(F.lit(2).alias("part"), F.concat(F.lit("  "), node_label(F.col("src")), F.lit(" -->|"), F.lower("type"), F.lit("| "), node_label(F.col("dst"))).alias("line"))
    return nodes.sparkSession.createDataFrame([(0, "graph TD")], "part int, line string").unionByName(n).unionByName(e)


def query(text: str, nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """GR6: ``callers X``, ``callees X`` or ``impact X``, X a method or Class.method, to nodes sorted by id.

    Methods are matched by class and name, which ids with paths would hide. ``callers`` is every
    non-CONTAINS edge into X that comes from a method.
    """
    verb, _, name = text.strip().partition(" ")
    owner, _, method = name.strip().rpartition(".")
    if verb not in ("callers", "callees", "impact") or not method:
        raise ValueError(f"expected: callers|callees|impact <name>, got {text!r}")
    seeds = nodes.where((F.col("type") == "METHOD") & (F.col("name") == method) & (F.lit(not owner) | (F.col("class_name") == owner)))
    if verb == "callees":
        ids = edges.where("type = 'CALLS'").join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    else:
        ids = impact(edges, seeds, 1 if verb == "callers" else depth).select("id")
    out = nodes.join(ids, "id", "left_semi")
    return (out if verb == "impact" else out.where("type = 'METHOD'")).orderBy("id")


def related(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """GR7: what is related to a file or class, with how: contained, parent, subclasses, implementations, dependencies, dependents."""
    hit = nodes.where((F.col("file_path") == name) & (F.col("type") == "FILE") | (F.col("name") == name) & F.col("type").isin("CLASS", "INTERFACE")).select("id")
    own = lambda kind, back, label: edges.where(F.col("type") == kind).join(hit.select(F.col("id").alias("dst" if back else "src")), "dst" if back else "src", "left_semi").select(F.col("src" if back else "dst").alias("id"), F.lit(label).alias("relation"))
    out = own("CONTAINS", False, "contains").unionByName(own("EXTENDS", False, "parent")).unionByName(own("EXTENDS", True, "subclass")).unionByName(own("IMPLEMENTS", True, "implementation"))
    out = out.unionByName(dependencies(edges, hit).withColumn("relation", F.lit("dependency"))).unionByName(dependents(edges, hit).withColumn("relation", F.lit("dependent")))
    return nodes.join(out.distinct(), "id").select("relation", "id", "type", "name", "file_path")


def class_hierarchy(facts: DataFrame) -> DataFrame:
    """Class to parent, from the indexes."""
    return indexes(facts)[2]
