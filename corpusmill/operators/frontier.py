"""Walks over captured link tables: breadth-first frontiers, successor chains, two-level indexes, robots rules."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .html import link_tail
from .scratch import written


def walk(edges: DataFrame, seeds: DataFrame, follow: Column | None = None, most_steps: int | None = None) -> DataFrame:
    """node, depth of everything reachable over edges(src, dst) from seeds(node); each node once, at its least depth.

    Ends when nothing new is reached; with most_steps, raises if more steps than that would reach something.
    """
    usable = edges.filter(follow) if follow is not None else edges
    seen = frontier = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in count(1):
        reached = frontier.join(usable, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = written(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        if most_steps is not None and depth > most_steps:
            raise ValueError(f"nodes are left after {most_steps} steps")
        seen = seen.unionByName(frontier)
        if depth % 32 == 0:  # a plan of bounded size however deep the walk is
            seen = written(seen)


def descends(parent: Column, child: Column) -> Column:
    """A child's slug strictly extends its parent's."""
    return F.startswith(child, F.concat(parent, F.lit("_"))) & (child != parent)


#: What the names of containers have in them, and what those of sections have.
CONTAINERS, SECTION = ("_title_", "_subtitle_", "_subchapter_", "_chapter_", "_part_", "_division_", "_article_"), "_section_"


def discover(links: DataFrame, codes: DataFrame, captured: DataFrame, most_steps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Walk the captured pages of several codes at once, downward from their seeds: containers and sections found.

    links(src, dst) are the resolved links of pages, codes(code, root, seed) has a row for each seed, captured(url) are the pages
    there are.  From a page of a code, links go on to containers whose name has the code's root and strictly extends the page's own,
    and give sections whose name has the root.  Each page is visited once a code.  Containers: code, url, depth, failed (no
    such page was captured).  Sections: code, url, depth, the least depth of a page that links it.
    """
    there = captured.select("url").distinct()
    roots = codes.select("code", "root").distinct()
    links = links.select(F.col("src").alias("url"), "dst").distinct()
    step = codes.select("code", F.col("seed").alias("url")).distinct().withColumn("depth", F.lit(0))
    containers = frontier = written(step, "frontier")
    holds = lambda marks, tail: F.coalesce(*(F.when(F.contains(tail, F.lit(m)), True) for m in marks), F.lit(False))
    out = lambda f: f.join(there, "url", "left_semi").join(roots, "code").join(links, "url").filter(F.contains(link_tail(F.col("dst")), F.col("root")))
    for depth in count(1):
        own, child = link_tail(F.col("url")), link_tail(F.col("dst"))
        down = out(frontier).filter(holds(CONTAINERS, child) & ~F.contains(child, F.lit(SECTION)) & (child != own) & F.startswith(child, own))
        reached = down.select("code", F.col("dst").alias("url")).distinct()
        frontier = written(reached.join(containers, ["code", "url"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        if most_steps is not None and depth > most_steps:
            raise ValueError(f"containers are left after {most_steps} steps")
        containers = containers.unionByName(frontier)
        if depth % 32 == 0:
            containers = written(containers, "containers")
    sections = out(containers).filter(F.contains(link_tail(F.col("dst")), F.lit(SECTION))).groupBy("code", F.col("dst").alias("url")).agg(F.min("depth").alias("depth"))
    failed = containers.join(there.withColumn("__there", F.lit(True)), "url", "left").select("code", "url", "depth", F.col("__there").isNull().alias("failed"))
    return failed, sections


def within_quota(sections: DataFrame, most: int, key: str = "code") -> DataFrame:
    """The first sections of each code by depth and name, those that are skipped or fail included in the number."""
    place = F.row_number().over(W.partitionBy(key).orderBy("depth", "url"))
    return sections.withColumn("place", place).filter(F.col("place") <= most)


def chain(pointers: DataFrame, start: str, prefix: str, most_steps: int | None = None) -> DataFrame:
    """Successors from a start while the name keeps the prefix: node, step.  pointers(node, next).

    By pointer doubling: each round jumps twice as far, so a chain of n takes about log2(n) rounds.  Ends when
    nothing new is reached; with most_steps, raises if the chain goes on beyond it.
    """
    kept = pointers.filter(F.startswith("next", F.lit(prefix))).select(F.col("node").alias("src"), F.col("next").alias("dst"))
    jump = written(kept.distinct())
    seen = written(pointers.filter(F.col("node") == start).select("node").distinct().withColumn("step", F.lit(0)))
    n, far = seen.count(), 1
    while True:
        reached = seen.join(jump, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("step") + far).alias("step"))
        seen = written(seen.unionByName(reached).groupBy("node").agg(F.min("step").alias("step")))
        found = seen.agg(F.count(F.lit(1)), F.max("step")).head()
        if most_steps is not None and (found[1] or 0) > most_steps:
            raise ValueError(f"the chain goes on after {most_steps} steps")
        if found[0] == n:
            return seen
        n, far = found[0], 2 * far
        on = jump.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
        jump = written(jump.join(on, "dst").select("src", F.col("end").alias("dst")).distinct())


def two_levels(links: DataFrame, root: Column, is_part: Column, is_section: Column) -> DataFrame:
    """root → parts → sections of a link table (src, dst)."""
    parts = links.filter(root & is_part).select(F.col("dst").alias("part"))
    return parts.join(links.filter(is_section), F.col("part") == F.col("src")).select("part", F.col("dst").alias("section")).distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """URLs of which no disallow rule (host-wide prefix) is a prefix.  Exact for any number of rules: a URL is
    looked up by each of its own prefixes of a rule's length, so it is an equi-join."""
    live = rules.filter(F.coalesce("disallow", F.lit("")) != "").select("disallow").distinct()
    lengths = [r[0] for r in live.select(F.length("disallow")).distinct().collect()]  # different lengths: few
    if not lengths:
        return urls
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in sorted(lengths))), lambda p: p.isNotNull())
    bad = urls.select(F.col(path).alias("__p"), F.explode(prefixes).alias("disallow")).join(live, "disallow").select("__p").distinct()
    return urls.join(bad, F.col(path) == F.col("__p"), "left_anti")
