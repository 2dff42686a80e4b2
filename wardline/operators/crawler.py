"""Distributed and crowdsourced crawlers: co-access graph, coverage, network spread, and their fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalars import contains_any, flag, jaccard, ratio, when_chain
from wardline.operators.components import connected_components
from wardline.storage import materialise, unclustered

PATTERNS = ["crowdsourced", "credential_stuffer", "ddos_tool", "scraper", "normal", "legit"]


# ---- windows


def grid_windows(records: DataFrame, seconds: int = 5) -> DataFrame:
    """Add ``win``: fixed windows of ``seconds``. The scalable form; anchored windows differ in where they are cut."""
    return records.withColumn("win", F.floor(F.unix_micros("ts") / (seconds * 1_000_000)).cast("long"))


def anchored_windows(records: DataFrame, seconds: float = 5, cell: int = 720) -> DataFrame:
    """Add ``win``: windows that start at the first event after the last one closed, and close ``seconds`` later.

    Where a window starts depends on all before it, so the log is cut into cells of ``cell`` window lengths, each
    folded by itself for every start it may be entered with. Starts soon fall together, so what a cell does to the start it
    is given is a table of a few rows; these tables, a few rows a cell whatever the number of events, are chained
    in one task, and each cell then gets its windows from the start it was really entered with.
    """
    size = int(seconds * 1e6)
    rows = records.filter("ts is not null").withColumn("_us", F.unix_micros("ts"))
    times = rows.select("_us").distinct().withColumn("cell", F.floor(F.col("_us") / (size * cell)).cast("long"))

    def ways(g: pd.DataFrame) -> pd.DataFrame:
        us, c = np.sort(g["_us"].to_numpy()), int(g["cell"].iloc[0])
        after = np.searchsorted(us, us + size, side="right")
        last = np.where(after < len(us), after, np.arange(len(us)))
        while (last[last] != last).any():
            last = last[last]
        first = last[: np.searchsorted(us, c * size * cell + size) + 1]  # the events a window from before may run up to
        ends = np.flatnonzero(np.r_[first[1:] != first[:-1], True])
        return pd.DataFrame({"cell": c, "upto": us[ends], "leave": us[first[ends]]})

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        start, cells, starts = np.iinfo(np.int64).min // 2, [], []
        for c, own in g.sort_values(["cell", "upto"]).groupby("cell"):
            cells.append(c)
            starts.append(start)
            k = int(np.searchsorted(own["upto"].to_numpy(), start + size, side="right"))
            start = int(own["leave"].iloc[k]) if k < len(own) else start
        return pd.DataFrame({"cell": cells, "before": starts})

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        us, start = np.sort(g["_us"].to_numpy()), int(g["before"].iloc[0])
        at, cuts, wins = 0, [], []
        while at < len(us):
            to = int(np.searchsorted(us, start + size, side="right"))
            cuts.append(to - at)
            wins.append(start)
            at = to
            start = int(us[to]) if to < len(us) else start
        return pd.DataFrame({"_us": us, "win": np.repeat(np.array(wins, dtype=np.int64), cuts)})

    table = materialise(times.groupBy("cell").applyInPandas(ways, "cell long, upto long, leave long"), "window-ways")
    before = table.groupBy(F.lit(0).alias("_all")).applyInPandas(chain, "cell long, before long")
    wins = times.join(before, "cell").groupBy("cell").applyInPandas(fold, "_us long, win long")
    return rows.join(wins, "_us").drop("_us")


# ---- co-access


TASK_PAIRS = 1 << 25  # candidate pairs that a task of co_access makes, about


def _session_words(windowed: DataFrame) -> DataFrame:
    """A row for every session and 64 windows (``_cell``) that it is in: its windows there as bits (``_word``), those of the cells before and after
    (``_prev``, ``_next``), and whether it spans more than 64 windows in all (``_wide``)."""
    rows = windowed.filter(F.coalesce("session_id", F.lit("")) != "").select(F.col("win").cast("long").alias("win"), "session_id").filter("win is not null")
    bit = F.bit_or(F.expr("shiftleft(1L, cast(win & 63 AS int))")).alias("_word")
    words = rows.groupBy("session_id", F.shiftright("win", 6).alias("_cell")).agg(bit, F.min("win").alias("_from"), F.max("win").alias("_to"))
    own = Window.partitionBy("session_id")
    near = lambda at, step: F.when(at("_cell").over(own.orderBy("_cell")) == F.col("_cell") + step, at("_word").over(own.orderBy("_cell"))).otherwise(F.lit(0).cast("long"))
    wide = F.max("_to").over(own) - F.min("_from").over(own) >= 64
    return words.select("session_id", "_cell", "_word", near(F.lag, -1).alias("_prev"), near(F.lead, 1).alias("_next"), wide.alias("_wide"))


def co_access(windowed: DataFrame, chunk: int = 16384) -> DataFrame:
    """(a, b, weight): all pairs of sessions that share a window, a < b, with the number of windows they share.

    A window's pairs are quadratic in its sessions; they are made in pairs of chunks of about ``chunk`` sessions, so
    that a large window is spread over many tasks. A session carries its windows within 64 of the present one as bits, so that a pair is counted
    where it first meets and no pair is shuffled; only pairs of sessions that both span more than 64 windows are added up, from a row for every
    64 windows. A session's pairs in a chunk lie together in the order of the others, which columnar files hold in few bytes.
    """
    words = materialise(_session_words(windowed), "session-words")
    rows = words.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter("getbit(_word, _r) = 1").select(
        (F.shiftleft("_cell", 6) + F.col("_r")).alias("win"), F.col("session_id").alias("id"), "_wide",
        F.expr("shiftleft(_word & ~shiftleft(-1L, _r), 64 - _r) | shiftrightunsigned(_prev, _r)").alias("behind"),  # bit j: 64 - j windows ago
        F.expr("shiftrightunsigned(_word, _r) | if(_r = 0, 0L, shiftleft(_next, 64 - _r))").alias("ahead"),  # bit j: in j windows
    )
    edges = _met(rows, chunk, "not (x_wide and y_wide) and x_behind & y_behind = 0", "bit_count(x_ahead & y_ahead)")
    if words.filter("_wide").isEmpty():
        return edges
    r = "cast(win & 63 AS int)"  # the window's place in its cell: a pair is counted where it first meets in the cell
    far = _met(rows.filter("_wide"), chunk, f"({r} = 0 or shiftrightunsigned(x_behind & y_behind, 64 - {r}) = 0)", f"bit_count(shiftleft(x_ahead & y_ahead, {r}))")
    return edges.union(far.groupBy("a", "b").agg(F.sum("weight").alias("weight")))


def _met(rows: DataFrame, chunk: int, counts: str, weight: str) -> DataFrame:
    """(a, b, weight): the pairs of a window's sessions for which ``counts`` holds, in as many tasks as the pairs ask for."""
    size = materialise(rows.groupBy("win").agg(F.count(F.lit(1)).alias("_n")), "window-sizes")
    pairs = size.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(pairs / TASK_PAIRS) + 1)
    s = rows.join(size.select("win", F.ceil(F.col("_n") / chunk).cast("int").alias("_n")), "win").withColumn("_c", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    key, held = ["win", "_p", "_q"], ["id", "behind", "ahead", "_wide"]
    one = s.select("win", F.col("_c").alias("_p"), F.explode(F.sequence("_c", F.col("_n") - 1)).alias("_q"), *(F.col(c).alias(f"x_{c.strip('_')}") for c in held))
    two = s.select("win", F.explode(F.sequence(F.lit(0), "_c")).alias("_p"), F.col("_c").alias("_q"), F.struct(*held).alias("_y"))
    two = two.repartition(tasks, *key).groupBy(*key).agg(F.sort_array(F.collect_list("_y")).alias("_ys"))
    met = one.repartition(tasks, *key).join(two, key).withColumn("_y", F.explode("_ys")).select(*key, "x_id", "x_behind", "x_ahead", "x_wide", *(F.col(f"_y.{c}").alias(f"y_{c.strip('_')}") for c in held))
    met = met.filter(f"(_p < _q or x_id < y_id) and {counts}")
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), F.expr(weight).cast("long").alias("weight"))


def window_members(windowed: DataFrame) -> DataFrame:
    """(win, session_id): the distinct named sessions of every window."""
    return windowed.filter(F.coalesce("session_id", F.lit("")) != "").select(F.col("win").cast("long").alias("win"), "session_id").distinct()


def star_edges(members: DataFrame) -> DataFrame:
    """(a, b, weight): every session of a window with the window's least one: the components of all pairs from n - 1 edges a window."""
    least = members.groupBy("win").agg(F.min("session_id").alias("a")).select(unclustered("win"), "a")
    return members.join(least, "win").filter("a < session_id").select("a", F.col("session_id").alias("b"), F.lit(1).alias("weight")).distinct()


LONG = 200  # windows of a session beyond which its pairs of windows are not listed; results don't depend on it


def peers_met(members: DataFrame, exact: int | None = None) -> DataFrame:
    """(session_id, peers): how many other sessions each session shares a window with, exactly (``exact`` is taken for older callers and changes nothing).

    The sizes of a session's windows count a peer once for every window they share. So peers are what the sizes add up to, less what those
    peers are counted too often that share several windows: they are found by the pairs of windows that they share, of which
    a peer of m windows shares m (m - 1) / 2. Sessions of the same windows are one class, and classes meet, not sessions.
    Classes of more than LONG windows don't list those pairs: they meet all classes by words of 64 windows, and their peers are the sessions of the classes
    they meet, those of a single window by the window.
    """
    size = members.groupBy("win").agg(F.count(F.lit(1)).alias("n")).select(unclustered("win"), "n")
    own = members.join(size, "win").groupBy("session_id").agg(F.sort_array(F.collect_list("win")).alias("wins"), F.sum("n").alias("total"))
    own = materialise(own.withColumn("k", F.size("wins")), "session-windows")
    single = own.filter("k = 1").select("session_id", (F.col("total") - 1).alias("peers"))
    # classes of two windows or more, named by a member
    classes = materialise(own.filter("k > 1").groupBy("wins").agg(F.min("session_id").alias("c"), F.count(F.lit(1)).alias("weight"), F.first("total").alias("total"), F.first("k").alias("k")), "window-classes")
    short, long = classes.filter(F.col("k") <= LONG), classes.filter(F.col("k") > LONG)
    pair = F.flatten(F.transform("wins", lambda w, i: F.transform(F.slice("wins", i + 2, F.size("wins")), lambda v: F.struct(w.alias("v"), v.alias("w")))))
    pairs = short.select("c", "weight", F.explode(pair).alias("_p")).select("c", "weight", "_p.v", "_p.w")
    met = pairs.select("v", "w", "c").join(pairs.select("v", "w", F.col("c").alias("d"), "weight"), ["v", "w"]).filter("c <> d").groupBy("c", "d").agg(F.count(F.lit(1)).alias("q"), F.first("weight").alias("weight"))
    extra = met.select("c", (F.col("weight") * (F.round((1 + F.sqrt(1 + 8 * F.col("q"))) / 2).cast("long") - 1)).alias("extra"))
    some_long = not long.isEmpty()
    if some_long:
        beside = materialise(_beside_long(classes, long), "long-classes")
        extra = extra.union(beside.select("c", F.col("again").alias("extra")))
    extra = extra.groupBy("c").agg(F.sum("extra").alias("extra"))
    # a class's own members share all its windows
    counted = short.join(extra, "c", "left").select("wins", (F.col("total") - F.col("weight") * (F.col("k") - 1) - F.coalesce("extra", F.lit(0)) - 1).alias("peers"))
    if some_long:
        alone = own.filter("k = 1").select(F.col("wins")[0].alias("win")).groupBy("win").agg(F.count(F.lit(1)).alias("_n")).select(unclustered("win"), "_n")
        alone = long.select("c", F.explode("wins").alias("win")).join(alone, "win").groupBy("c").agg(F.sum("_n").alias("alone"))
        several = long.join(alone, "c", "left").join(beside.select("c", "others"), "c", "left")
        counted = counted.union(several.select("wins", (F.coalesce("alone", F.lit(0)) + F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("peers")))
    return single.union(own.filter("k > 1").join(counted, "wins").select("session_id", "peers"))


def _beside_long(classes: DataFrame, long: DataFrame) -> DataFrame:
    """(c, again, others) of the classes that meet a long one: how often too often windows count the long classes' sessions; for long classes, the sessions of the other classes they meet."""

    def words(x: DataFrame) -> DataFrame:
        x = x.select("c", "weight", F.explode("wins").alias("win")).groupBy("c", "weight", F.shiftright("win", 6).alias("_cell"))
        return x.agg(F.bit_or(F.expr("shiftleft(1L, cast(win & 63 AS int))")).alias("_word"))

    other = words(long).select("_cell", F.col("c").alias("d"), F.col("weight").alias("_weight"), F.col("_word").alias("_other"))
    met = words(classes).join(other, "_cell").filter("c <> d and _word & _other <> 0")
    met = met.groupBy("c", "d").agg(F.sum(F.expr("bit_count(_word & _other)")).alias("q"), F.first("weight").alias("weight"), F.first("_weight").alias("_weight"))
    ends = F.array(F.struct("c", F.expr("_weight * (q - 1)").alias("again"), F.lit(0).cast("long").alias("others")), F.struct(F.col("d").alias("c"), F.lit(0).cast("long").alias("again"), F.col("weight").alias("others")))
    return met.select(F.explode(ends).alias("_x")).select("_x.*").groupBy("c").agg(F.sum("again").alias("again"), F.sum("others").alias("others"))


def clusters(edges: DataFrame, least_weight: int = 1, least_size: int = 3) -> DataFrame:
    """(session_id, cluster_id, cluster_size): components of the co-access graph; the id is the least member.

    ``edges``: of ``star_edges`` where one shared window links, of ``co_access`` where more are asked for.
    """
    strong = edges.filter(F.col("weight") >= least_weight)
    names = strong.select(F.col("a").alias("session_id")).union(strong.select("b")).distinct()
    coded = names.withColumn("node", F.xxhash64("session_id"))
    comp = connected_components(strong.select(F.xxhash64("a"), F.xxhash64("b")).toDF("x", "y"))
    members = coded.join(comp, "node")
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"), F.min("session_id").alias("cluster_id")).filter(F.col("cluster_size") >= least_size)
    return members.join(size, "component").select("session_id", "cluster_id", "cluster_size")


def window_clusters(members: DataFrame, least_size: int = 3) -> DataFrame:
    """(session_id, cluster_id, cluster_size): ``clusters(star_edges(members))``, found over windows.

    A session links its least window with its others, and every session is in the component of its windows. Rounds go over edges
    of windows, which are as many as the time has, not over sessions.
    """
    own = members.groupBy("session_id").agg(F.min("win").alias("_w"))
    edges = materialise(members.join(own, "session_id").filter("win > _w").select("_w", "win").distinct(), "window-edges")
    first = members.groupBy("session_id").agg(F.min("win").alias("node"))
    of = first.join(connected_components(edges), "node", "left").select("session_id", F.coalesce("component", "node").alias("component"))
    of = materialise(of, "session-components")
    size = of.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size"), F.min("session_id").alias("cluster_id")).filter(F.col("cluster_size") >= max(least_size, 2))
    return of.join(size.select(unclustered("component"), "cluster_size", "cluster_id"), "component").select("session_id", "cluster_id", "cluster_size")


def co_access_scores(members: DataFrame, met: DataFrame, records: DataFrame, peers: int = 10) -> DataFrame:
    """(session_id, co_access): mean of the share of cluster mates it meets and its path overlap with the first ``peers`` of them.

    ``met``: (session_id, peers) of ``peers_met``, where one shared window links, so that all whom a session meets are in its cluster; or the edges (a, b)
    of ``co_access``, of which those inside clusters count. Overlaps are counted over distinct paths, not over sets in a row.
    """
    if "peers" not in met.columns:
        both = met.select(F.col("a").alias("session_id"), F.col("b").alias("peer")).union(met.select("b", "a"))
        mates = members.select(F.col("session_id").alias("peer"), F.col("cluster_id").alias("_c"))
        met = both.join(members.select("session_id", "cluster_id"), "session_id").join(mates, "peer").filter("cluster_id = _c").groupBy("session_id").agg(F.count(F.lit(1)).alias("peers"))
    share = members.join(met, "session_id").select("session_id", (F.col("peers") / (F.col("cluster_size") - 1)).alias("peer_ratio"))
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("session_id"))).filter(F.col("_r") <= peers + 1)
    first = materialise(first.select("cluster_id", "session_id", "_r"), "first-peers")
    # a session meets the paths of its cluster's first peers by an equal join and counts them by peer: no row a pair
    paths = materialise(records.select("session_id", "path").distinct().join(members.select("session_id", "cluster_id"), "session_id"), "cluster-paths")
    theirs = paths.join(first.select("session_id", "_r"), "session_id")
    known = theirs.filter("path is not null").groupBy("cluster_id", "path").agg(F.collect_list("_r").alias("_rs"))
    common = [F.count_if(F.array_contains("_rs", k)).alias(f"_b{k}") for k in range(1, peers + 2)]
    own = paths.join(known, ["cluster_id", "path"], "left").groupBy("session_id", "cluster_id").agg(F.count("path").alias("n"), *common)
    sizes = theirs.groupBy("cluster_id", "session_id", "_r").agg(F.count("path").alias("m"))
    mates = sizes.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct(F.col("_r").alias("r"), F.col("session_id").alias("id"), "m"))).alias("_mates"))
    # the first peers + 1 of the cluster without the session itself, at most peers of them: the last goes if the session is not among them
    sims = own.join(mates.select(F.col("cluster_id").alias("_cluster"), "_mates"), F.col("cluster_id") == F.col("_cluster")).withColumn("_both", F.array(*(f"_b{k}" for k in range(1, peers + 2))))
    mine = F.exists("_mates", lambda p: p["id"] == F.col("session_id"))
    used = F.filter("_mates", lambda p: (p["id"] != F.col("session_id")) & (mine | (p["r"] <= peers)))
    alike = F.transform(used, lambda p: ratio(F.get("_both", p["r"] - 1).cast("double"), F.col("n") + p["m"] - F.get("_both", p["r"] - 1)))
    sims = sims.filter(F.size(used) > 0).select("session_id", (F.aggregate(alike, F.lit(0.0), lambda a, x: a + x) / F.size(used)).alias("overlap"))
    return share.join(sims, "session_id").select("session_id", F.round((F.col("peer_ratio") + F.col("overlap")) / 2, 4).alias("co_access"))


# ---- coverage


def resource_space(paths: DataFrame, group: str = "grp", compat: bool = False) -> DataFrame:
    """(group, estimated): size of the resource space behind the distinct paths of each group.

    ``/base/<n>`` and ``/base?page=<n>`` count their largest number + 2, other paths 1. ``compat`` also counts a
    paged path as a static one.
    """
    item, page = F.regexp_extract("path", r"^(/.+?)/(\d+)$", 1), F.regexp_extract("path", r"^(/.+?)\?.*page[=](\d+)", 1)
    rows = paths.select(group, "path").distinct().withColumns({
        "_item": item, "_page": page, "_n": F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(path, '/([0-9]+)$', 1), '') as long)"), F.expr("try_cast(nullif(regexp_extract(path, 'page=([0-9]+)', 1), '') as long)")),
    })
    key = F.when(F.col("_item") != "", F.col("_item")).when(F.col("_page") != "", F.concat("_page", F.lit("?page")))
    sized = rows.withColumn("_key", key)
    est = sized.filter("_key is not null").groupBy(group, "_key").agg((F.max("_n") + 2).alias("e")).select(group, "e")
    fixed = sized.filter("_key is null" if not compat else "_item = ''").select(group, F.lit(1).cast("long").alias("e"))
    return est.union(fixed).groupBy(group).agg(F.sum("e").alias("estimated"))


def sequential_scores(session_paths: DataFrame, group: str = "grp", cap: int | None = None) -> DataFrame:
    """(group, sequential): share of sessions with two trailing ids or more (``cap``: among the first so many of each group) whose ids rise or step evenly."""
    ids = F.filter(F.transform("paths", lambda p: F.nullif(F.regexp_extract(p, r"/(\d+)$", 1), F.lit("")).try_cast("long")), lambda v: v.isNotNull())
    x = session_paths
    if cap:
        x = x.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("session_id"))).filter(F.col("_r") <= cap)
    x = x.withColumn("ids", ids).filter(F.size("ids") >= 2)
    steps = F.zip_with(F.slice("ids", 2, F.size("ids")), F.slice("ids", 1, F.size("ids") - 1), lambda b, a: b - a)
    good = F.forall("steps", lambda s: s > 0) | ((F.size("ids") >= 3) & F.forall("steps", lambda s: s == F.col("steps")[0]))
    return x.withColumn("steps", steps).groupBy(group).agg(F.avg(flag(good)).alias("sequential"))


def coverage(records: DataFrame, group: str | Column = "pattern", compat: bool = False, cap: int | None = None) -> DataFrame:
    """Coverage of the resources by group and over all (grp = ``*``): completeness, entropy, idle and sequential shares, flags.

    Groups of fewer than two sessions are left out. One grouping by (session, path), then counts. ``cap``: see ``sequential_scores``.
    """
    g = F.col(group) if isinstance(group, str) else group
    hits = records.select(F.explode(F.array(g.cast("string"), F.lit("*"))).alias("grp"), "session_id", "path").groupBy("grp", "session_id", "path").agg(F.count(F.lit(1)).alias("n"))
    sessions = hits.groupBy("grp", "session_id").agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("path")).alias("paths"))
    idle = sessions.groupBy("grp").agg(F.count(F.lit(1)).alias("sessions"), F.avg(flag(F.col("n") <= 2)).alias("idle_session_ratio")).filter("sessions >= 2")
    freq = hits.groupBy("grp", "path").agg(F.count(F.lit(1)).cast("double").alias("f"))
    total = freq.groupBy("grp").agg(F.sum("f").alias("t"), F.count(F.lit(1)).alias("total_unique_paths"))
    # H = log2 t - sum(f log2 f) / t
    ent = freq.groupBy("grp").agg(F.sum(F.col("f") * F.log2("f")).alias("flf")).join(total, "grp")
    entropy = F.when(F.col("total_unique_paths") > 1, (F.log2("t") - F.col("flf") / F.col("t")) / F.log2(F.col("total_unique_paths").cast("double"))).otherwise(1.0)
    seq = sequential_scores(sessions, cap=cap)
    out = idle.join(ent, "grp").join(resource_space(freq, "grp", compat), "grp").join(seq, "grp", "left")
    complete = F.least(F.lit(1.0), ratio(F.col("total_unique_paths").cast("double"), F.col("estimated").cast("double")))
    low = (entropy < 0.75) & (F.col("idle_session_ratio") > 0.3)
    pieces = (F.col("total_unique_paths") >= 5) & (complete > 0.5) & (F.col("idle_session_ratio") > 0.3)
    return out.select(
        "grp", "sessions", F.round(complete, 4).alias("coverage_completeness"), F.round(entropy, 4).alias("coverage_entropy"), F.round(F.coalesce("sequential", F.lit(0.0)), 4).alias("sequential_score"),
        F.round("idle_session_ratio", 4).alias("idle_session_ratio"), low.alias("suspicious_low_entropy"), pieces.alias("suspicious_fragmented"), (low | pieces).alias("suspicious_coverage"),
        "total_unique_paths", F.col("estimated").alias("estimated_resource_space"),
    )


# ---- network


def session_pattern(session_id: Column | str = "session_id") -> Column:
    """Pattern that the session's name carries. Names that carry a class leak it; pass another column where there is one."""
    c = F.col(session_id) if isinstance(session_id, str) else session_id
    return when_chain((contains_any(c, [p]), F.lit(p)) for p in PATTERNS).otherwise(F.lit("unknown"))


def group_similarity(sessions: DataFrame, group: str = "pattern", cap: int | None = None, chunk: int = 1024) -> DataFrame:
    """(group, similarity): mean Jaccard of the path sets of all pairs of the group's sessions (``cap``: of its first so many); 0 below two sessions.

    Sessions of the same paths are one set with a weight, and sets meet in pairs of chunks of about ``chunk``: a task holds a table of a pair of
    chunks, and what comes out of it are numbers of pairs by the sizes of their intersection and union, which are whole, so that sums are exact.
    The work is quadratic in a group's different sets, not in its sessions.
    """
    x = sessions.filter(F.col(group).isNotNull())
    if cap:
        x = x.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("session_id"))).filter(F.col("_r") <= cap)
    sets = x.groupBy(F.col(group).alias("g"), F.array_sort(F.array_distinct(F.array_compact("paths"))).alias("paths")).agg(F.count(F.lit(1)).alias("n"))
    sets = materialise(sets, "path-sets")
    own = sets.groupBy("g").agg(F.sum("n").alias("_n"), F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks"), F.sum(F.when(F.size("paths") > 0, F.expr("n * (n - 1) div 2")).otherwise(0)).alias("_equal"))
    own = materialise(own, "path-set-groups")
    dealt = sets.filter(F.size("paths") > 0).join(own.select("g", "_chunks"), "g").withColumn("_c", F.pmod(F.xxhash64("paths"), F.col("_chunks")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    dealt = dealt.select("g", F.least("_c", "_o").alias("p"), F.greatest("_c", "_o").alias("q"), (F.col("_c") <= F.col("_o")).alias("first"), "paths", "n")
    met = dealt.groupBy("g", "p", "q").applyInPandas(_chunks_met, f"g {sets.schema['g'].dataType.simpleString()}, shared long, united long, pairs long")
    met = met.groupBy("g", "shared", "united").agg(F.sum("pairs").alias("pairs")).groupBy("g").agg(F.sum(F.col("pairs") * (F.col("shared") / F.col("united"))).alias("_s"))
    total = F.col("_n").cast("double") * (F.col("_n") - 1) / 2
    sims = own.filter("_n > 1").join(met, "g", "left").select(F.col("g").alias("_g"), ((F.coalesce("_s", F.lit(0.0)) + F.col("_equal")) / total).alias("similarity"))
    return sessions.select(group).distinct().join(sims, F.col(group) == F.col("_g"), "left").select(group, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def _chunks_met(rows: pd.DataFrame) -> pd.DataFrame:
    """How many pairs of sessions of two chunks of path sets (of one, if they are the same) share and unite so many paths; pairs that share none are left out."""
    size, n = rows["paths"].map(len).to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
    path, of = pd.factorize(np.concatenate(rows["paths"].to_numpy()))[0], np.repeat(np.arange(len(rows)), size)
    first, same = rows["first"].to_numpy(dtype=bool), rows["p"].iloc[0] == rows["q"].iloc[0]
    sides = [np.arange(len(rows))] * 2 if same else [np.flatnonzero(first), np.flatnonzero(~first)]
    place = np.zeros(len(rows), dtype=np.int64)
    for side in sides:
        place[side] = np.arange(len(side))
    shared = np.zeros([len(side) for side in sides], dtype=np.int32)
    by = np.argsort(path, kind="stable")
    for own in np.split(of[by], np.flatnonzero(np.diff(path[by])) + 1):
        a, b = (own, own) if same else (own[first[own]], own[~first[own]])
        shared[np.ix_(place[a], place[b])] += 1  # a set holds a path once
    x, y = np.nonzero(np.triu(shared, 1) if same else shared)
    i, a, b = shared[x, y].astype(np.int64), sides[0][x], sides[1][y]
    united = size[a] + size[b] - i
    base = int(united.max(initial=0)) + 1
    kinds, kind = np.unique(i * base + united, return_inverse=True)
    pairs = np.zeros(len(kinds), dtype=np.int64)
    np.add.at(pairs, kind, n[a] * n[b])
    return pd.DataFrame({"g": pd.Series([rows["g"].iloc[0]] * len(pairs), dtype=object), "shared": kinds // base, "united": kinds % base, "pairs": pairs})


def network_scores(sessions: DataFrame, similarity: DataFrame, group: str = "pattern") -> DataFrame:
    """(session_id, network_score): fixed scores by pattern, the scraper's from its similarity."""
    p = F.col(group)
    score = (
        F.when(p == "scraper", F.round(F.least(F.lit(1.0), F.col("similarity") * 1.5), 4)).when(p == "ddos_tool", 0.9).when(p == "credential_stuffer", 0.8)
        .when(p == "crowdsourced", 0.15).when(p == "normal", 0.1).when(p == "legit", 0.2).otherwise(0.0)
    )
    return sessions.join(similarity, group).select("session_id", score.alias("network_score"))


PREFIXES = {8: 0.2, 16: 0.3, 24: 0.5}  # bits of an address's prefix, and the weight of its level


def _prefix(bits: int) -> Column:
    return F.substring_index("source_ip", ".", bits // 8)


def prefix_rollup(records: DataFrame, group: str = "pattern") -> DataFrame:
    """(group, bits, prefixes, requests, entropy, divergence): how a group's requests are spread over address prefixes.

    ``entropy`` of the group's own distribution; ``divergence`` from all requests' distribution (Kullback-Leibler), both in bits: 0 where the
    group comes from everywhere as all do, large where it sits in few prefixes. Requests without an address are left out.
    """
    level = F.explode(F.array(*(F.struct(F.lit(b).alias("bits"), _prefix(b).alias("prefix")) for b in PREFIXES)))
    own = records.filter("source_ip is not null").select(group, level.alias("x")).groupBy(group, "x.bits", "x.prefix").agg(F.count(F.lit(1)).cast("double").alias("f"))
    every = own.groupBy("bits", "prefix").agg(F.sum("f").alias("all"))
    total = every.groupBy("bits").agg(F.sum("all").alias("t"))
    mine = own.groupBy(group, "bits").agg(F.sum("f").alias("n"))
    x = own.join(every, ["bits", "prefix"]).join(mine.select(F.col(group).alias("_g"), F.col("bits").alias("_b"), "n"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("bits") == F.col("_b"))).join(total, "bits")
    p = F.col("f") / F.col("n")
    g = x.groupBy(group, "bits").agg(F.count(F.lit(1)).alias("prefixes"), F.max("n").cast("long").alias("requests"), F.sum(-p * F.log2(p)).alias("entropy"), F.sum(p * F.log2(p / (F.col("all") / F.col("t")))).alias("divergence"))
    return g.select(group, "bits", "prefixes", "requests", F.round(F.abs("entropy"), 6).alias("entropy"), F.round(F.greatest("divergence", F.lit(0.0)), 6).alias("divergence"))


def prefix_scores(records: DataFrame, group: str = "pattern") -> DataFrame:
    """(session_id, network_score): its group's concentration, the weighted mean over the levels of 1 - 2^-divergence, without any name's hint."""
    weight = when_chain((F.col("bits") == b, F.lit(w)) for b, w in PREFIXES.items())
    score = prefix_rollup(records, group).groupBy(group).agg(F.round(F.sum(weight * (1 - F.pow(F.lit(2.0), -F.col("divergence")))), 4).alias("network_score"))
    of = records.groupBy("session_id").agg(F.min(group).alias("_g"))
    return of.join(score, F.col("_g").eqNullSafe(F.col(group)), "left").select("session_id", F.coalesce("network_score", F.lit(0.0)).alias("network_score"))


def crowd_stats(sessions: DataFrame) -> DataFrame:
    """Share of the malicious sessions with at most two requests."""
    bad = F.contains("session_id", F.lit("malicious"))
    g = sessions.agg(F.count_if(bad).alias("malicious"), F.count_if(bad & (F.col("n") <= 2)).alias("small"))
    share = ratio(F.col("small").cast("double"), F.col("malicious").cast("double"))
    return g.select("malicious", "small", share.alias("crowdsourced_ratio"), (share > 0.3).alias("crowdsourced_flag"))


# ---- fusion


def fusion(records: DataFrame, seconds: int = 5, group: Column | None = None, network: DataFrame | None = None, anchored: bool = False, cap: int | None = None) -> DataFrame:
    """Verdict of every session from the three layers, weights .35, .35, .30.

    ``group``: the pattern column (by default read from the session's name); ``network``: (session_id,
    network_score), by default the fixed scores of the patterns; ``cap``: see ``sequential_scores``.
    """
    rows = records.withColumn("pattern", group if group is not None else session_pattern())
    rows = materialise(rows.select("session_id", "pattern", "path", "ts"), "fusion-rows")  # five branches read these columns
    sessions = rows.groupBy("session_id").agg(F.first("pattern").alias("pattern"), F.count(F.lit(1)).alias("n"), F.collect_set("path").alias("paths"))
    windowed = anchored_windows(rows, seconds) if anchored else grid_windows(rows, seconds)
    inside = materialise(window_members(windowed), "fusion-windows")
    members = materialise(window_clusters(inside), "fusion-members")
    score = co_access_scores(members, peers_met(inside), rows)
    net = network if network is not None else network_scores(sessions, group_similarity(sessions))
    cov = coverage(rows, "pattern", cap=cap).withColumnRenamed("grp", "_grp")
    names = ["coverage_entropy", "coverage_completeness", "sequential_score", "idle_session_ratio", "suspicious_low_entropy", "suspicious_fragmented"]
    glob = cov.filter("_grp = '*'").select(*(F.col(c).alias(f"g_{c}") for c in names))
    x = sessions.join(members, "session_id", "left").join(score, "session_id", "left").join(net, "session_id", "left")
    x = x.join(cov, F.col("pattern") == F.col("_grp"), "left").crossJoin(F.broadcast(glob))
    x = x.select("session_id", "pattern", "cluster_id", "cluster_size", "co_access", "network_score", *(F.coalesce(c, f"g_{c}").alias(c) for c in names))
    inside = F.col("cluster_id").isNotNull()
    temporal = F.coalesce("co_access", F.lit(0.0)) * F.when(inside, 1.0).otherwise(0.3)
    cover = F.greatest(F.lit(0.0), (1 - F.col("coverage_entropy")) * F.when(F.col("suspicious_low_entropy"), 0.6).otherwise(0.2) + F.col("coverage_completeness") * 0.25 + F.col("sequential_score") * 0.15)
    n = F.coalesce("network_score", F.lit(0.0))
    x = x.withColumns({"temporal_score": temporal, "coverage_score": cover, "_n": n})
    fused = 0.35 * F.col("temporal_score") + 0.35 * F.col("coverage_score") + 0.30 * F.col("_n")
    x = x.withColumn("_f", fused)
    verdict = (
        F.when((F.col("pattern") == "crowdsourced") & F.col("suspicious_fragmented") & (F.col("_n") <= 0.3), "crowdsourced_crawler")
        .when(inside & (F.col("_n") > 0.4) & (F.col("suspicious_low_entropy") | (F.col("coverage_completeness") > 0.3)) & (F.col("_f") >= 0.55), "distributed_crawler")
        .when(F.col("_f") >= 0.5, "suspicious").otherwise("normal")
    )
    return x.select(
        "session_id", "pattern", verdict.alias("determination"), F.round("_f", 4).alias("fusion_score"), F.round("temporal_score", 4).alias("temporal_score"), F.round("coverage_score", 4).alias("coverage_score"),
        F.round("_n", 4).alias("network_score"), inside.alias("in_cluster"), F.coalesce("cluster_size", F.lit(0)).alias("cluster_size"), "cluster_id",
    )


def cluster_rollup(verdicts: DataFrame, members: int = 10) -> DataFrame:
    """Size, mean fusion score, first ``members`` members and verdict of every cluster.

    Scores have four digits: their mean is taken over whole ten-thousandths and rounded half up, so it is exact. A
    large cluster's first members come from those of each task.
    """
    own = verdicts.filter("cluster_id is not null")
    g = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.sum(F.round(F.col("fusion_score") * 10_000).cast("long")).alias("s"))
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("session_id"))).filter(F.col("_r") <= members)
    names = first.groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_list("session_id")), ",").alias("members"))
    verdict = F.when(F.expr("s >= 5500 * size"), "distributed_crawler").when(F.expr("s >= 4500 * size"), "suspicious").otherwise("normal")
    return g.join(names, "cluster_id").select("cluster_id", "size", (F.expr("(2 * s + size) div (2 * size)") / 10_000).alias("avg_fusion_score"), "members", verdict.alias("determination"))


def global_assessment(verdicts: DataFrame) -> DataFrame:
    d = F.col("determination")
    return verdicts.agg(
        F.coalesce(F.bool_or(d == "distributed_crawler"), F.lit(False)).alias("has_distributed"), F.coalesce(F.bool_or(d == "crowdsourced_crawler"), F.lit(False)).alias("has_crowdsourced"),
        *(F.count_if(d == k).alias(f"{k}_count") for k in ("distributed_crawler", "crowdsourced_crawler", "suspicious")),
    )


def run_summary(verdicts: DataFrame, truth: str = "true_category") -> DataFrame:
    """Distribution of true categories over determinations."""
    return verdicts.groupBy(truth, "determination").count()
