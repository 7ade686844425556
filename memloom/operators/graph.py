"""The navigation graph over realms and domains, links between them, and the decay of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.history import with_neighbours
from memloom.session import written

FLOOR, STEP, MOST = 0.05, 0.05, 5.0


def domain_nodes(entities: DataFrame) -> DataFrame:
    """(domain, realms, gates, n, dates): realms and gates sorted, the last five dates; domain ``general`` and blank
    realms are left out. ``entities``: realm, domain, gate, date."""
    e = entities.where((F.col("domain") != "general") & (F.trim("realm") != ""))
    # The dates of a domain are few distinct days, so the set stays small whatever the number of rows.
    days = F.array_sort(F.collect_set("date"))
    last = F.slice(days, F.greatest(F.size(days) - 4, F.lit(1)), 5)
    return e.groupBy("domain").agg(F.array_sort(F.collect_set("realm")).alias("realms"), F.array_sort(F.collect_set("gate")).alias("gates"), F.count(F.lit(1)).alias("n"), last.alias("dates"))


def domain_edges(nodes: DataFrame) -> DataFrame:
    """(domain, realm_a, realm_b, gate, n) for each pair of a domain's realms and each of its gates."""
    pairs = F.flatten(F.transform("realms", lambda a: F.transform(F.filter("realms", lambda b: a < b), lambda b: F.struct(a.alias("realm_a"), b.alias("realm_b")))))
    return nodes.where("size(gates) > 0").select("domain", "n", F.explode(pairs).alias("p"), "gates").select("domain", "p.*", F.explode("gates").alias("gate"), "n")


def traverse(nodes: DataFrame, start: str, hops: int = 2, most: int = 50) -> DataFrame:
    """Domains reached from ``start`` over shared realms: (domain, hop, n, via): via is the realms shared with the
    first domain, by name, of the hop before that leads there; nearest first, then larger first."""
    own = nodes.select("domain", "realms", "n")
    frontier = own.where(F.col("domain") == start).select("domain", "realms", F.lit(0).alias("hop"), "n", F.lit(None).cast("string").alias("via"))
    seen = frontier
    for hop in range(1, hops + 1):
        by_realm = frontier.select(F.col("domain").alias("by"), F.explode("realms").alias("realm"))
        near = own.select("domain", "n", "realms", F.explode("realms").alias("realm")).join(by_realm, "realm").join(seen.select("domain"), "domain", "left_anti")
        best = near.groupBy("domain").agg(F.min("by").alias("by"))
        via = near.join(best, ["domain", "by"]).groupBy("domain").agg(F.first("realms").alias("realms"), F.first("n").alias("n"), F.array_join(F.array_sort(F.collect_set("realm")), ",").alias("via"))
        frontier = written(via.select("domain", "realms", F.lit(hop).alias("hop"), "n", "via"))
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0").select("domain", "hop", "n", "via").orderBy("hop", F.desc("n"), "domain").limit(most)


def link_id(*ends: Column) -> Column:
    """The same id for both directions of a link: 16 hex digits of the hash of the sorted ends."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array(*ends)), "↔"), 256), 1, 16)


def shared_topics(topics: DataFrame, least: int) -> DataFrame:
    """Pairs of realms that share topics: (realm_a, realm_b, shared, topics); ``topics``: realm, topic. Topics are
    compared trimmed and in lower case, pairs with fewer than ``least`` are left out. A topic's realms are the few
    names of the realms table, so a topic's pairs are bounded by their number."""
    t = topics.select("realm", F.lower(F.trim("topic")).alias("topic")).where("topic <> ''").distinct()
    by = t.groupBy("topic").agg(F.array_sort(F.collect_set("realm")).alias("rs"))
    pairs = F.flatten(F.transform("rs", lambda a: F.transform(F.filter("rs", lambda b: a < b), lambda b: F.struct(a.alias("realm_a"), b.alias("realm_b")))))
    p = by.select("topic", F.explode(pairs).alias("p")).select("topic", "p.*")
    return p.groupBy("realm_a", "realm_b").agg(F.count(F.lit(1)).alias("shared"), F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics")).where(F.col("shared") >= least)


def co_occurrence(rows: DataFrame, least: int) -> DataFrame:
    """Gateways within a realm: (realm, a, b, n, domains) for names a < b that stand together in at least ``least``
    rows. ``rows``: realm, domain, names (few and distinct in a row)."""
    r = rows.withColumn("names", F.array_sort(F.array_distinct("names")))
    pairs = F.flatten(F.transform("names", lambda a: F.transform(F.filter("names", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = r.select("realm", "domain", F.explode(pairs).alias("p")).select("realm", "domain", "p.*")
    return p.groupBy("realm", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains")).where(F.col("n") >= least)


def decayed(strength: Column, stability: Column, days: Column) -> Column:
    """Strength after ``days``: exponential forgetting with a floor; unchanged for no or negative time."""
    s = F.when(stability > 0, stability).otherwise(1.0)
    return F.when(days > 0, F.greatest(F.lit(FLOOR), strength * F.exp(-days / s))).otherwise(strength)


def potentiated(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Strength, stability and number of activations of each key after all its events, from strength 1 and stability 1:
    each adds .05 to strength, at most 5; stability grows by .1 if an hour has passed since the event before.

    The fold has a closed form, so it needs counts only; gaps are found between neighbouring moments of a key, with
    large keys cut into stretches of time.
    """
    moments = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias("c"))
    near = with_neighbours(moments, [key], "t", ["t"], [])
    rested = (F.coalesce(F.col("t") - F.col("prev_t"), F.lit(3_600_000_000)) >= 3_600_000_000).cast("int")
    out = near.groupBy(key).agg(F.sum("c").alias("activations"), F.sum(rested).alias("rested"))
    return out.select(key, F.round(F.least(F.lit(MOST), 1 + STEP * F.col("activations")), 6).alias("strength"), F.round(1 + 0.1 * F.col("rested"), 6).alias("stability"), "activations")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component, for edges (a, b). Labels spread to neighbours and
    jump to the label of the label, until none changes; only a flag reaches the driver."""
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        new = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("near"))
        up = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = written(new.join(up, "near", "left").select("node", F.least("near", "far").alias("component"), (F.least("near", "far") != F.col("component")).alias("moved")))
        labels = new.select("node", "component")
        if not new.where("moved").limit(1).count():
            return labels


def likeness(name: Column, text: str) -> Column:
    """1 if ``text`` is part of the name or the reverse, .5 if a word of it is, else 0."""
    low = F.lower(name)
    words = [w for w in text.lower().replace("_", "-").split("-") if w]
    part = F.lit(False)
    for w in words:
        part = part | low.contains(w)
    return F.when(low.contains(text.lower()) | F.contains(F.lit(text.lower()), low), 1.0).when(part, 0.5).otherwise(0.0)
