"""Problem 1: variant spellings of names typed by people.

Method: names become weighted vectors of character n-grams; a distributed sparse cosine join finds all
pairs above a threshold (n-grams ordered by rarity, prefix filtering, sparse blocks multiplied per n-gram);
the thresholded graph falls into components, and average-linkage clustering of the cosines groups each.
All pairs above the threshold are kept instead of the n best of each name, so that no link is lost.

One feature besides the cosine: a link whose words contradict each other loses `APART`, as two different
full given names, or two different initials, are two people whatever their family name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.components import components
from tagloom.operators.skew import lookup_join
from tagloom.operators.streamed import grouped_rows
from tagloom.session import cut

#: Cosine below which two names have no link, and average similarity below which clusters stay apart.
COSINE, LINKAGE = 0.42, 0.1
#: What a link loses where the words contradict each other.
APART = 1.5
#: A word is common (given name, adjective, kind of band) if at least this share of names, and at least so many, have it.
COMMON_SHARE, COMMON_LEAST = 0.0008, 15
#: Components of more names than this are clustered in distributed rounds instead of one task, with the same result.
COMPONENT = 600
#: Rows of a tile where one n-gram has more names; vectors of more n-grams than the second number are not sent to blocks.
TILE, LONG = 500, 400

# Short forms of English given names and their full forms.
NICKNAMES = """
abby abigail|alex alexander|al albert|andy andrew|tony anthony|ben benjamin|becky rebecca|bill william|billy william|will william|willy william|liam william|
bob robert|bobby robert|rob robert|robbie robert|charlie charles|chuck charles|chris christopher|dan daniel|danny daniel|dave david|deb deborah|debbie deborah|
ed edward|eddie edward|ted edward|ned edward|liz elizabeth|lizzie elizabeth|beth elizabeth|betty elizabeth|eliza elizabeth|fred frederick|freddie frederick|freddy frederick|greg gregory|
harry henry|hank henry|jim james|jimmy james|jen jennifer|jenny jennifer|joe joseph|joey joseph|jo josephine|josie josephine|kate katherine|katie katherine|kathy katherine|kitty katherine|
larry lawrence|maggie margaret|meg margaret|peggy margaret|marge margaret|matt matthew|mike michael|mick michael|mickey michael|nate nathaniel|nick nicholas|pat patricia|patty patricia|tricia patricia|trish patricia|
pete peter|phil philip|rick richard|rich richard|dick richard|richie richard|ron ronald|sam samuel|sammy samuel|steve stephen|sue susan|susie susan|suzy susan|theo theodore|teddy theodore|tim timothy|timmy timothy|
tom thomas|tommy thomas|vicky victoria|vic victoria|tori victoria|nicky nicholas|kathryn katherine|gabe gabriel|jerry gerald|jeff jeffrey|ken kenneth|len leonard|manny emanuel|mandy amanda|nancy ann|nell helen|nellie helen|ray raymond|sandy alexandra|stan stanley|terry terence|val valerie|walt walter|zach zachary|zack zachary|jess jessica|cathy catherine|cindy cynthia|dot dorothy|ellie eleanor|fran frances|frank francis|gus augustus|jack john|johnny john|jon jonathan|josh joshua|kim kimberly|lou louis|marty martin|max maximilian|mitch mitchell|molly mary|polly mary|ollie oliver|penny penelope|reggie reginald|russ russell|sally sarah|sid sidney|tina christina|toby tobias|vince vincent|wally walter
"""
# Short forms of words in names of bands.
SHORT_FORMS = """
bros brothers|bro brothers|sis sisters|orch orchestra|orchestr orchestra|chmbr chamber|chbr chamber|ch chamber|ens ensemble|ensem ensemble|coll collective|co company|comp company|cmpny company|qrt quartet|qt quartet|qtet quartet|4tet quartet|qnt quintet|5tet quintet|3o trio|
st saint|proj project|sess sessions|assem assembly|assm assembly|sing singers|cart cartographers|gard gardeners|art artists|va various|assy assembly
"""
DROPPED = {"the", "and", "of", "thee", "teh", "hte"}
NICK = dict(x.split(" ") for x in NICKNAMES.replace("\n", "").split("|"))
SHORT = dict(x.split(" ") for x in SHORT_FORMS.replace("\n", "").split("|"))
# Romanisation of Cyrillic and Greek letters without a decomposition, and of Latin letters with a stroke.
ROMAN = dict(zip("абвгдезийклмнопрстуфхцыэіј", "abvgdeziiklmnoprstufhcyeij", strict=True)) | {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "ё": "e", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"}


@lru_cache(maxsize=100_000)
def name_words(name: str) -> tuple[str, ...]:
    """Canonical words of a name, sorted: no accents, lower case, short forms written out, articles and joining words dropped."""
    text = unicodedata.normalize("NFKD", name).lower()
    text = "".join(ROMAN.get(c, c) for c in text if not unicodedata.combining(c))
    words = [SHORT.get(w, NICK.get(w, w)) for w in re.findall(r"[^\W_]+", text.replace("'", "").replace("’", ""))]
    if "various" in words and set(words) <= {"various", "artist", "artists"}:
        return ("various",)
    kept = [w for w in words if w not in DROPPED]
    return tuple(sorted(kept or words))


def ngrams(words: tuple[str, ...], n: int = 3) -> list[str]:
    """Distinct n-grams of the padded words; a single letter gives itself."""
    out = set()
    for w in words:
        padded = f"^{w}$"
        out.update(padded[i : i + n] for i in range(max(1, len(padded) - n + 1)))
    return sorted(out)


def close(a: str, b: str) -> bool:
    """Equal but for typing: one edit (or swap of neighbours), two in words of eight letters and more."""
    if a == b:
        return True
    short, long = sorted((len(a), len(b)))
    limit = 0 if short < 3 else 1 if long < 8 else 2
    # an edit changes at most two letters of the sets
    if long - short > limit or len(set(a) ^ set(b)) > 2 * limit:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return row[-1] <= limit


def agree(a: tuple[str, ...], b: tuple[str, ...], common: frozenset[str] | set[str]) -> bool:
    """Whether the words of two names can be of one act.

    Words are paired off: equal ones first, then typing variants, then initials with full words, then words
    written together. What is left decides: initials may be missing on one side, other words may not, and
    at least one rare word (or two common ones) must have been paired.
    """
    left, right, sure, plain = list(a), list(b), 0, 0
    for w in list(left):
        if w in right:
            left.remove(w)
            right.remove(w)
            if len(w) > 1:
                sure += w not in common
                plain += w in common
    for w in list(left):
        for v in right:
            # two common words that differ are two words (Anna, Anne), but a common word and a rare one may be a typing variant
            if len(w) > 2 and len(v) > 2 and not (w in common and v in common) and close(w, v):
                left.remove(w)
                right.remove(v)
                sure += w not in common and v not in common
                plain += w in common or v in common
                break
    for w in list(left):
        for v in right:
            if (len(w) == 1) != (len(v) == 1) and w[0] == v[0]:
                left.remove(w)
                right.remove(v)
                break
    for one, other in ((left, right), (right, left)):  # words written together
        for w in list(one):
            parts = [v for v in other if len(v) > 1 and v in w]
            if len(parts) > 1 and sum(map(len, parts)) == len(w):
                one.remove(w)
                for v in parts:
                    other.remove(v)
                sure += 1
    if sure == 0 and plain < 2:
        return False
    if any(len(w) > 1 for w in left + right):
        return False
    return not (left and right)


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [name_words(n) for n in pdf["name"]]
        yield pd.DataFrame({"id": pdf["id"], "words": [list(w) for w in words], "grams": [ngrams(w) for w in words]})


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, v): `vectors` (id, grams) as arrays of (code, df, w) from rare n-grams to common ones, of length 1."""
    grams = vectors.select("id", F.explode("grams").alias("g"))
    counted = grams.groupBy("g").agg(F.count("*").alias("df"))
    # codes follow the order of rarity over all range partitions
    coded = cut(counted.repartitionByRange("df", "g").sortWithinPartitions("df", "g").withColumn("code", F.monotonically_increasing_id()).withColumn("rows", F.col("df")))
    n, total = vectors.count(), coded.agg(F.sum("df")).first()[0] or 0
    weighted = lookup_join(grams, coded, "g", "rows", total).withColumn("w", F.log(F.lit(float(n + 1)) / F.col("df")) + 0.1)
    arrays = weighted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("code", "df", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return cut(arrays.select("id", F.transform("v", lambda x: F.struct(x["code"].alias("code"), x["df"].alias("df"), (x["w"] / F.col("norm")).alias("w"))).alias("v")))


def _block_cosines(cosine: float):
    """Rows (id, tile, codes, weights) that share an n-gram of their prefixes -> (x, y, cosine) of the pairs that reach the cosine."""

    def run(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        rows.sort(key=lambda r: r[0])
        ids, tiles = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        codes, at = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
        matrix = np.zeros((len(rows), len(codes)))
        matrix[np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]), at] = np.concatenate([r[3] for r in rows])
        close_by = np.triu(matrix @ matrix.T, 1)
        if tiles.min() != tiles.max():
            close_by[tiles[:, None] == tiles[None, :]] = 0
        i, j = np.nonzero(close_by >= cosine)
        return list(zip(ids[i].tolist(), ids[j].tolist(), close_by[i, j].round(9).tolist(), strict=True))

    return run


def similar_pairs(vectors: DataFrame, cosine: float) -> DataFrame:
    """(x, y, cosine) of all pairs x < y of `vectors` (id, grams) with at least that cosine, by prefix filtering.

    The n-grams of a vector are ordered from rare to common; those after which the rest is shorter than the
    threshold can't reach it alone, so a pair that does shares an n-gram before them on both sides. The vectors
    that share one are multiplied as a sparse block, in tiles of about `TILE` rows where an n-gram has more.
    Vectors of more than `LONG` n-grams (texts, not names) don't travel with each of their n-grams; their pairs are
    found by ids first.
    """
    unit = unit_vectors(vectors)
    limit = 1 - cosine * cosine  # the squared length from the rare end on tells where the prefix ends
    sums = F.aggregate("v", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda acc, x: F.struct((acc["s"] + x["w"] * x["w"]).alias("s"), (acc["k"] + F.when(acc["s"] <= limit, 1).otherwise(0)).alias("k")))
    prefix = F.explode(F.slice("v", F.lit(1), sums["k"])).alias("x")
    # an n-gram of one name meets nothing
    short = unit.where(F.size("v") <= LONG).select("id", "v", prefix).where("x.df > 1")
    tiles = F.ceil(F.col("x.df") / TILE).cast("int")
    placed = short.withColumn("tile", F.pmod(F.xxhash64("id"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    block = F.concat_ws(".", "x.code", F.least("tile", "other"), F.greatest("tile", "other"))
    blocks = placed.select(block.alias("block"), "id", "tile", F.col("v.code").alias("codes"), F.col("v.w").alias("weights"))
    found = grouped_rows(blocks, "block", [], _block_cosines(cosine), "x long, y long, cosine double")
    long = cut(unit.where(F.size("v") > LONG))
    if not long.isEmpty():
        ends = unit.select(F.col("id").alias("b"), prefix).select("b", "x.code")
        met = long.select(F.col("id").alias("a"), prefix).select("a", "x.code").join(ends, "code").where("a <> b").select("a", "b").distinct()
        met = met.join(long.select(F.col("id").alias("a"), F.map_from_entries(F.transform("v", lambda x: F.struct(x["code"], x["w"]))).alias("va")), "a").join(unit.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
        dot = F.aggregate("vb", F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.try_element_at("va", e["code"]), F.lit(0.0)))
        found = found.unionByName(met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.round(dot, 9).alias("cosine")).where(F.col("cosine") >= cosine))
    return found.groupBy("x", "y").agg(F.max("cosine").alias("cosine"))


def average_linkage(n: int, sims: dict[tuple[int, int], float], threshold: float) -> list[int]:
    """Cluster labels of n items: the two clusters with the highest average similarity merge while it is at least `threshold`.

    Pairs without a similarity count as 0. Ties go to the clusters with the smallest first members.
    """
    members = {i: [i] for i in range(n)}
    total: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    for (i, j), s in sims.items():
        total[i][j] = total[j][i] = s
    while True:
        best, at = threshold, None
        for i, row in total.items():
            for j, s in row.items():
                if i < j:
                    mean = s / (len(members[i]) * len(members[j]))
                    if mean > best or (mean == best and at is None):
                        best, at = mean, (i, j)
        if at is None:
            break
        i, j = at
        members[i] += members.pop(j)
        for k, s in total.pop(j).items():
            total[k].pop(j)
            if k != i:
                total[i][k] = total[k][i] = total[i].get(k, 0.0) + s
    labels = [0] * n
    for i, group in members.items():
        for k in group:
            labels[k] = i
    return labels


def _cluster(threshold: float):
    """Rows (x, y, sim, words and common words of x, of y) of one component -> (id, act)."""

    def run(rows: list[tuple]) -> list[tuple]:
        words = {r[0]: (tuple(r[3].split(" ")), set(r[4].split(" "))) for r in rows} | {r[1]: (tuple(r[5].split(" ")), set(r[6].split(" "))) for r in rows}
        ids = sorted(words)
        at = {v: i for i, v in enumerate(ids)}
        sims = {(at[r[0]], at[r[1]]): r[2] for r in rows}
        for i, x in enumerate(ids):
            for j in range(i + 1, len(ids)):
                if (i, j) not in sims:
                    (wx, cx), (wy, cy) = words[x], words[ids[j]]
                    sims[i, j] = 0.0 if agree(wx, wy, cx | cy) else -APART
        labels = average_linkage(len(ids), sims, threshold)
        return [(i, ids[k]) for i, k in zip(ids, labels, strict=True)]

    return run


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yes = np.array([agree(tuple(a), tuple(b), set(ca) | set(cb)) for a, b, ca, cb in zip(pdf["wx"], pdf["wy"], pdf["cx"], pdf["cy"], strict=True)], bool)
        yield pdf[["x", "y"]].assign(sim=pdf["cosine"].to_numpy() - np.where(yes, 0.0, APART))


def acts(names: DataFrame, key: str, name: str, cosine: float = COSINE, linkage: float = LINKAGE) -> DataFrame:
    """(id, act): each name with the smallest id of the names of its act.

    Null names and names without letters or digits are acts of their own. Equal names are one act. Keys must
    be distinct; other columns are ignored; an empty table gives no rows.
    """
    rows = names.select(F.col(key).alias("id"), F.col(name).alias("name"))
    vectors = cut(rows.where("name IS NOT NULL").mapInPandas(_vectors, "id long, words array<string>, grams array<string>").where("size(grams) > 0"))
    # equal canonical words are one node
    form = F.array_join("words", " ")
    nodes = cut(vectors.withColumn("form", form).groupBy("form").agg(F.min("id").alias("id"), F.first("words").alias("words"), F.first("grams").alias("grams")))
    n = nodes.count()
    least = max(COMMON_LEAST, int(n * COMMON_SHARE))
    common = nodes.select("id", F.explode("words").alias("w")).distinct()
    frequent = common.groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") >= least).select("w")
    listed = common.join(frequent, "w").groupBy("id").agg(F.collect_list("w").alias("c"))
    described = cut(nodes.join(listed, "id", "left").select("id", "words", F.coalesce("c", F.array().cast("array<string>")).alias("c")))
    pairs = similar_pairs(nodes.select("id", "grams"), cosine)
    pairs = pairs.join(described.select(F.col("id").alias("x"), F.col("words").alias("wx"), F.col("c").alias("cx")), "x").join(described.select(F.col("id").alias("y"), F.col("words").alias("wy"), F.col("c").alias("cy")), "y")
    links = cut(pairs.mapInPandas(_agreeing, "x long, y long, sim double"))
    labelled = clustered(links, described, linkage)
    members = vectors.withColumn("form", form).select(F.col("id").alias("member"), "form").join(nodes.select("form", "id"), "form").join(labelled, "id", "left").select(F.col("member").alias("id"), F.coalesce("act", "id").alias("act"))
    return rows.select("id").join(members, "id", "left").select("id", F.coalesce("act", "id").alias("act"))


def clustered(links: DataFrame, described: DataFrame, linkage: float, size: int = COMPONENT) -> DataFrame:
    """(id, act) by average linkage of the links (x, y, sim); `described` has id, words and common words c.

    Pairs of one component without a link have similarity 0, or -APART if their words contradict each other. Only
    names joined by positive links can merge, so components are clustered apart. One of more than `size` names is
    not gathered but clustered by distributed rounds of mutual best merges, with the same result: averages never
    grow by merging others, so such merges come out whatever their order.
    """
    links = cut(links)
    parts = cut(components(links.where("sim > 0"), "x", "y"))
    big = cut(parts.groupBy("component").agg(F.count("*").alias("m")).where(F.col("m") > size).select("component"))
    ends = parts.select(F.col("node").alias("y"), F.col("component").alias("other"))
    edges = cut(links.join(parts.select(F.col("node").alias("x"), "component"), "x").join(ends, "y").where("component = other").select("component", "x", "y", "sim"))
    text = described.select("id", F.array_join("words", " ").alias("w"), F.array_join("c", " ").alias("c"))
    small = edges.join(big, "component", "left_anti").join(text.toDF("x", "wx", "cx"), "x").join(text.toDF("y", "wy", "cy"), "y").select("component", "x", "y", "sim", "wx", "cx", "wy", "cy")
    out = grouped_rows(small, "component", ["x", "y"], _cluster(linkage), "id long, act long")
    if big.isEmpty():
        return out
    nodes = parts.join(big, "component").select(F.col("node").alias("id"), "component").join(text, "id")
    linked = edges.join(big, "component").select("x", "y", "sim")
    other = agreeing_pairs(nodes).join(linked, ["x", "y"], "left_anti").withColumn("sim", F.lit(0.0))
    return out.unionByName(merged(nodes.select("id"), linked.unionByName(other), linkage))


def agreeing_pairs(nodes: DataFrame) -> DataFrame:
    """(x, y): all pairs x < y of one component whose words agree; `nodes` has id, component, words w and common words c.

    Every tile of a component meets every other one in a group of its own.
    """
    tiled = nodes.withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("component").orderBy("id")) - 1) / TILE).cast("int"))
    tiled = cut(tiled.withColumn("last", F.max("tile").over(Window.partitionBy("component"))))
    met = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    met = met.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        rows = [(i, t, tuple(w.split(" ")), set(c.split(" "))) for i, t, w, c in zip(pdf["id"], pdf["tile"], pdf["w"], pdf["c"], strict=True)]
        rows.sort(key=lambda r: r[0])
        found = [(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if (same or a[1] != b[1]) and agree(a[2], b[2], a[3] | b[3])]
        return pd.DataFrame(found, columns=["x", "y"]).astype("int64")

    return met.groupBy("component", "i", "j").applyInPandas(run, "x long, y long")


def merged(nodes: DataFrame, pairs: DataFrame, linkage: float) -> DataFrame:
    """(id, act): average linkage of `nodes` (id) in distributed rounds; pairs that `pairs` (x, y, sim) doesn't list are at -APART.

    In a round every two clusters that are the best of each other merge; ties go to the smallest first members.
    """
    of = cut(nodes.select("id", F.col("id").alias("act")))
    table = cut(pairs.select("x", "y", (F.col("sim") + APART).alias("total")))
    while True:
        sizes = of.groupBy("act").agg(F.count("*").alias("n"))
        met = table.join(sizes.toDF("x", "nx"), "x").join(sizes.toDF("y", "ny"), "y")
        near = cut(met.select("x", "y", (F.col("total") / (F.col("nx") * F.col("ny")) - APART).alias("mean")).where(F.col("mean") >= linkage))
        if near.isEmpty():
            return of
        top = F.max(F.struct("mean", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))).alias("top")
        best = near.withColumn("end", F.explode(F.array("x", "y"))).groupBy("end").agg(top).select((-F.col("top.x")).alias("x"), (-F.col("top.y")).alias("y"))
        into = cut(best.groupBy("x", "y").count().where("count = 2").select("y", "x").toDF("old", "into"))
        of = cut(of.join(into, of["act"] == into["old"], "left").select("id", F.coalesce("into", "act").alias("act")))
        for end in ("x", "y"):
            table = table.join(into.toDF(end, "into"), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        table = cut(table.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "total").groupBy("x", "y").agg(F.sum("total").alias("total")))


def act_pairs(found: DataFrame) -> DataFrame:
    """(credit_id_a, credit_id_b): all pairs of names of one act; acts have a few spellings each."""
    a, b = found.alias("a"), found.alias("b")
    joined = a.join(b, (F.col("a.act") == F.col("b.act")) & (F.col("a.id") < F.col("b.id")))
    return joined.select(F.col("a.id").alias("credit_id_a"), F.col("b.id").alias("credit_id_b"))
