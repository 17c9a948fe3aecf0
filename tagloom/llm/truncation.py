"""Problem 4: text cut off by field limits or broken transfers.

Method: hashed logistic regression. Intact values are cut artificially, at the limits found in the data
and at random places, to create positives; the model sees closing characters and words, punctuation,
the distance to the source's limit, and how the last word occurs in the corpus. Then every record is scored.

The limits of the sources, the word statistics and the counts of whole values come from all rows; only
the model is fitted on a bounded sample (`SAMPLE` rows).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.skew import lookup_join
from tagloom.session import cut

#: Bound of the training sample: at most so many intact values per field, drawn from rows so that frequent values come often.
SAMPLE = 10_000
#: Size of the hashed feature space.
DIMENSION = 1 << 17
#: Share of training values that are cut at random, as transfers do, and the weight of such an example.
BROKEN_SHARE, BROKEN_WEIGHT = 0.5, 0.015
#: A value counts as cut if that is more likely than not.
THRESHOLD = 0.5
#: Beginnings are counted of words of up to so many characters; longer runs are no words.
LONGEST_WORD = 64
#: Where at least so many distinct values, and this share of the values that reach a length, stop there, it is a limit unless more than the last share of those of the other sources stop there too.
STOPPED, STOP_SHARE, STOP_OTHERS = 8, 0.9, 0.3
MARKS = ("…", "...")


def closing(value: str) -> tuple[str, str]:
    """The value without a mark of omission, and the mark."""
    for mark in MARKS:
        if value.endswith(mark):
            return value[: -len(mark)].rstrip(), mark
    return value, ""


def last_word(value: str) -> str:
    """The last run of letters, digits and marks in lower case, without a mark of omission before it."""
    found = re.findall(r"[^\W_]+", closing(value)[0].lower())
    return found[-1] if found else ""


def bucket(n: float) -> int:
    return 0 if n <= 0 else min(8, int(n).bit_length())


def distance(length: int, limit: int) -> int:
    """Room left below the limit, in coarse steps; 99: no limit, -1: longer than the limit."""
    if limit <= 0:
        return 99
    room = limit - length
    return -1 if room < 0 else room if room < 4 else 4 if room < 8 else 5


def skeleton(words: list[str], common: frozenset[str]) -> list[str]:
    return [w if w in common else "0" if w.isdigit() else "R" if re.fullmatch("[ivxlc]+", w) else "W" for w in words]


# Function words and set words of titles in the languages of the data, whose order shows whether a title is whole.
COMMON = frozenset(
    """a an the and or of in on at to for from with before after by no vol volume op opus part pt live feat song sonata suite quartet partita fantasia
    nocturnes sonatas quartets complete every needs who owns what don t wake waiting final version acoustic edit radio mix original motion picture soundtrack
    deluxe edition remastered remaster bonus anniversary expanded instrumental demo single album session sessions collection sampler presents selects orchestra
    chamber choir major minor flat sharp brothers sisters band trio quintet der die das und im am de la le les el los las y e o du des""".split()
)


@lru_cache(maxsize=1 << 18)
def slot(field: str, name: str) -> int:
    """Place of a feature in the hashed space; most features recur all the time."""
    return zlib.crc32((f"{field}|{name}" if field else name).encode("utf-8", "surrogatepass")) % DIMENSION


def features(value: str, field: str, chars: int, byte: int, whole: float, word_any: float, word_end: float, longer: float, pair_any: float, pair_end: float, pair_longer: float) -> list[int]:
    """Hashed features of one value; `chars` and `byte` are `distance`s, the others corpus counts without the
    value itself: equal values, the last word anywhere and at an end, and longer words that begin with it; then
    the same for the last word behind the word before it."""
    body, mark = closing(value)
    words = re.findall(r"[^\W_]+", body.lower())
    shape = skeleton(words, COMMON)
    s1, s2, s3, s4, first = (*(" ".join(shape[-k:]) for k in (1, 2, 3, 4)), "".join(shape[:1]))
    last = words[-1] if words else ""
    opened = sum(map(body.count, "([{")) - sum(map(body.count, ")]}"))
    room = min(chars if chars != 99 else 50, byte if byte != 99 else 50)
    end = body[-1:] or "^"
    kind = "L" if end.isalpha() else "D" if end.isdigit() else end
    same, some, more = bucket(whole), bucket(word_any), bucket(longer)
    known = f"{some}.{-1 if word_any <= 0 else round(4 * word_end / word_any)}"
    part = f"{min(3, some)}.{more}.{round(4 * word_any / (word_any + longer)) if longer > 0 else 9}"
    two, two_more = bucket(pair_any), bucket(pair_longer)
    pair = f"{min(3, two)}.{two_more}.{round(4 * pair_any / (pair_any + pair_longer)) if pair_longer > 0 else 9}"
    pair_rate = f"{min(4, two)}.{-1 if pair_any <= 0 else round(4 * pair_end / pair_any)}"
    names = [
        f"m{mark}", f"e{end}", f"k{kind}", f"u{min(2, max(-1, opened))}", f"r{room}", f"rk{room}{kind}", f"rm{room}{mark}",
        f"w{known}", f"wk{known}{len(last)}", f"wr{known}.{room}", f"f{same}", f"fr{same}.{room}", f"fw{same}.{known}", f"l{min(len(last), 9)}",
        f"s1{s1}", f"s2{s2}", f"s3{s3}", f"s4{s4}", f"sf{first}{s3}", f"sa{' '.join(shape[:12])}{mark}", f"sn{first}{len(shape)}", f"sm{s3}{mark}",
        f"lw{last if last in COMMON else ''}{room}", f"c1{body[-1:]}{room}", f"c2{body[-2:]}", f"c3{body[-3:]}", f"case{body[-len(last):].islower() if last else 0}{body[:1].isupper()}", f"b{body.count('(')}{opened > 0}{room}", f"mu{mark}{opened > 0}", f"n{min(len(words), 8)}",
        f"p{part}", f"pr{part}.{room}", f"pk{part}.{min(len(last), 6)}", f"pn{part}.{min(len(words), 3)}", f"ps{part}{''.join(shape[-2:-1])}",
        f"q{pair}", f"qm{pair}{mark}", f"qr{pair}.{room}", f"qp{pair}.{part}", f"qf{pair}.{same}", f"qw{pair_rate}", f"qe{pair_rate}.{same}.{kind}", f"qk{pair_rate}.{known}",
    ]
    return [slot(field, n) for n in names] + [slot("", n) for n in (*names[:22], *names[-13:])]


def fit(rows: list[list[int]], labels: np.ndarray, importance: np.ndarray, epochs: int = 5, rate: float = 0.15, decay: float = 2e-4, seed: int = 1) -> np.ndarray:
    """Logistic regression by AdaGrad over mini-batches; the last weight is the intercept."""
    rng = np.random.default_rng(seed)
    width = max(map(len, rows))
    x = np.full((len(rows), width), DIMENSION + 1, np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    w, g = np.zeros(DIMENSION + 2), np.full(DIMENSION + 2, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 256):
            part = order[k : k + 256]
            f = x[part]
            p = 1 / (1 + np.exp(-np.clip(w[f].sum(1) + w[DIMENSION], -30, 30)))
            d = (p - labels[part]) * importance[part] / 16
            grad = np.zeros(DIMENSION + 2)
            np.add.at(grad, f.ravel(), np.repeat(d, width))
            grad[DIMENSION], grad[DIMENSION + 1] = d.sum(), 0
            hit = np.flatnonzero(grad)
            grad[hit] += decay * w[hit]
            g[hit] += grad[hit] ** 2
            w[hit] -= rate * grad[hit] / np.sqrt(g[hit])
        w[DIMENSION + 1] = 0
    return w


def prior_shift(z: np.ndarray, n: np.ndarray, prior: float, rounds: int = 50) -> float:
    """Expectation-maximisation of a source's share of cut values, as a shift of log-odds learned under `prior`."""
    base, share = np.log(prior / (1 - prior)), prior
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) - base
        share = float(np.clip((n / (1 + np.exp(-(z + odds)))).sum() / n.sum(), 1e-5, 0.5))
    return float(np.log(share / (1 - share)) - base)


def limits(lengths: DataFrame) -> list[dict]:
    """The field limits of the sources: dicts of source, field, unit (chars or bytes) and limit.

    `lengths` has (source, field, unit, length, n, k): n rows and k distinct values, one row per length, not per
    value. A limit is the length beyond which a source has hardly any values though the others have, and at which
    its values pile up; or, however few values reach it, the length at which nearly all of those stop though those
    of the others go on. Of a limit in characters and one in bytes, the one that explains the pile better is kept.
    """
    pdf = lengths.toPandas()  # sources x fields x lengths that occur, not rows
    out: dict[tuple[str, str], dict] = {}
    for (field, unit), part in pdf.groupby(["field", "unit"]):
        everyone = part.groupby("length")["n"].sum().sort_index()
        total_all, beyond_all = everyone.sum(), everyone[::-1].cumsum()[::-1] - everyone
        for source, mine in part.groupby("source"):
            mine = mine.set_index("length").sort_index()
            own, total = mine["n"], mine["n"].sum()
            others_total = total_all - total
            if others_total <= 0:
                continue
            own_beyond = own[::-1].cumsum()[::-1] - own
            counts = own.to_dict()
            at = lambda k: np.array([counts.get(i - k, 0) for i in own.index])  # noqa: B023, E731
            rest, rest_beyond = everyone[own.index] - own, beyond_all[own.index] - own_beyond
            others, share, pile, before = rest_beyond / others_total, own_beyond / total, own + at(1), (at(2) + at(3) + at(4) + at(5)) / 2
            enough = mine["k"] >= STOPPED
            good = enough & (others > 0.01) & (share < 0.15 * others) & (share < 0.03) & (pile > 0.02 * total) & (pile > 0.3 * (others - share) * total) & (pile > 1.2 * before)
            # of the values that reach a length, the share that stops there, of this source and of the others
            stop = own / (own + own_beyond).clip(lower=1)
            good |= enough & (stop >= STOP_SHARE) & (rest_beyond >= STOPPED) & (rest / (rest + rest_beyond).clip(lower=1) <= STOP_OTHERS)
            if good.any():
                limit = int(own[good].idxmax())
                explained = int(own[limit] - own_beyond[limit])
                if (source, field) not in out or explained > out[source, field]["explained"]:
                    out[source, field] = {"source": source, "field": field, "unit": unit, "limit": limit, "explained": explained}
    return list(out.values())


WORD = r"[\p{L}\p{N}]+"


def _words(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(value, r"(…|\.\.\.)$", "")), F.lit(WORD), F.lit(0))


def _pairs(value: Column) -> Column:
    """Every word of a value with the one before it (`^` at the start) and whether it is the last."""
    w = _words(value)
    return F.transform(w, lambda x, i: F.struct(F.coalesce(F.get(w, i - 1), F.lit("^")).alias("before"), x.alias("last"), (i == F.size(w) - 1).alias("e")))


def _statistics(free: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corpus counts over the values of sources without a limit: (field, value, whole), and per (field, before, last) the
    rows with that pair of words, with it at their end and with a longer last word, and the same for the last word alone."""
    whole = cut(free.groupBy("field", "value").agg(F.sum("n").alias("whole")))
    seen = whole.select("field", "whole", F.explode(_pairs(F.col("value"))).alias("x")).select("field", "whole", "x.*")
    pairs = cut(seen.groupBy("field", "before", "last").agg(F.sum("whole").alias("n"), F.sum(F.when(F.col("e"), F.col("whole")).otherwise(0)).alias("end")))
    return whole, pairs


def _heads(words: DataFrame, by: list[str]) -> DataFrame:
    """(*by, last, longer): every proper beginning of the words `last`, with the rows `n` of the words that go on from it."""
    long = words.where(f"n > 0 AND length(last) BETWEEN 2 AND {LONGEST_WORD}")
    return long.select(*by, "n", F.explode(F.expr("transform(sequence(1, length(last) - 1), k -> substr(last, 1, k))")).alias("last")).groupBy(*by, "last").agg(F.sum("n").alias("longer"))


def _with_counts(values: DataFrame, whole: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds the corpus counts of the value and of its last word, without the value's own `own` and `own_longer` rows.

    Counts are joined to the distinct ends of the values first; the values then look their end up, hot ends by broadcast.
    """
    w = _words(F.col("value"))
    v = values.withColumn("ending", F.struct("field", F.coalesce(F.try_element_at(w, F.lit(-2)), F.lit("^")).alias("before"), F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit("")).alias("last")))
    v = cut(v)
    words = pairs.groupBy("field", "last").agg(F.sum("n").alias("n"), F.sum("end").alias("end"))
    ends = v.groupBy("ending").agg(F.count("*").alias("k")).select("ending", "k", "ending.*")
    ends = ends.join(words.select("field", "last", F.col("n").alias("n_any"), F.col("end").alias("n_end")), ["field", "last"], "left").join(_heads(words.groupBy("last").agg(F.sum("n").alias("n")), []), "last", "left")
    two = pairs.select("field", "before", "last", F.col("n").alias("two_any"), F.col("end").alias("two_end"))
    ends = ends.join(two, ["field", "before", "last"], "left").join(_heads(pairs, ["field", "before"]).withColumnRenamed("longer", "two_longer"), ["field", "before", "last"], "left")
    ends = cut(ends.select("ending", "k", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_any", "n_end", "longer", "two_any", "two_end", "two_longer"))))
    total = ends.agg(F.sum("k")).first()[0] or 0
    v = lookup_join(v, ends, "ending", "k", total).join(whole, ["field", "value"], "left").fillna(0, ["whole"])
    less = lambda c, own: F.greatest(F.lit(0), F.col(c) - F.col(own)).alias(c)
    return v.select(*values.columns, *(less(c, "own") for c in ("whole", "n_any", "n_end", "two_any", "two_end")), *(less(c, "own_longer") for c in ("longer", "two_longer")))


def _feature_rows(pdf: pd.DataFrame) -> list[list[int]]:
    return [
        features(v, f, distance(len(v), lc), distance(len(v.encode("utf-8", "surrogatepass")), lb), *counts)
        for v, f, lc, lb, *counts in zip(pdf["value"], pdf["field"], pdf["limit_chars"], pdf["limit_bytes"], *(pdf[c].tolist() for c in ("whole", "n_any", "n_end", "longer", "two_any", "two_end", "two_longer")), strict=True)
    ]


def _cut_examples(pdf: pd.DataFrame, found: list[dict], seed: int) -> pd.DataFrame:
    """Intact values under a random limit of their field: those longer than it are cut; some more are cut anywhere."""
    rng = np.random.default_rng(seed)
    rows = []
    by_field: dict[str, list[dict]] = {}
    for x in found:
        by_field.setdefault(x["field"], []).append(x)
    for value, field, own in zip(pdf["value"], pdf["field"], pdf["own"], strict=True):
        options = by_field.get(field, [])
        for limit in [*([options[rng.integers(len(options))]] if options else []), None]:
            lc = limit["limit"] if limit and limit["unit"] == "chars" else 0
            lb = limit["limit"] if limit and limit["unit"] == "bytes" else 0
            text, label, weight = value, 0, 1.0
            mark = "…" if limit and limit.get("marked") else ""
            if lc and len(value) > lc:
                text, label = value[: lc - len(mark)].rstrip() + mark, 1
            elif lb and len(value.encode("utf-8", "surrogatepass")) > lb:
                text, label = value.encode("utf-8", "surrogatepass")[:lb].decode("utf-8", "ignore").rstrip(), 1
            elif limit is None and len(value) > 6 and rng.random() < BROKEN_SHARE:
                text = value[: rng.integers(3, len(value))].rstrip() + ("", "", "…", "...")[rng.integers(4)]
                label, weight = 1, BROKEN_WEIGHT
            if label and not closing(text)[0]:
                continue
            rows.append((text, field, lc, lb, own if label == 0 else 0, own if label else 0, label, weight))
    return pd.DataFrame(rows, columns=["value", "field", "limit_chars", "limit_bytes", "own", "own_longer", "label", "weight"])


def _source(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("source")


def scored(rows: DataFrame, key: str, fields: list[str], source: str) -> tuple[DataFrame, dict]:
    """(source, field, value, n, free, p) for every distinct value of each source, p: how likely it is cut, free: the source has no limit there; and facts on the model.

    Null values give no rows and empty ones get p = 0; a null source counts as the source ''. Equal values of one source get equal results. With no
    rows, or no value to train on, every p is 0.
    """
    spark = rows.sparkSession
    long = rows.select(_source(source), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x"), F.col(key).alias("key")).select("key", "source", "x.field", "x.value").where("value IS NOT NULL")
    values = cut(long.groupBy("source", "field", "value").agg(F.count("*").alias("n")))
    lengths = values.where("value <> ''").select("source", "field", "n", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("value").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("value").alias("length")))).alias("x")).groupBy("source", "field", "x.unit", "x.length").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    found = limits(lengths)
    limited = spark.createDataFrame([(x["source"], x["field"], x["limit"] if x["unit"] == "chars" else 0, x["limit"] if x["unit"] == "bytes" else 0) for x in found], "source string, field string, limit_chars int, limit_bytes int")
    values = cut(values.join(limited, ["source", "field"], "left").withColumn("free", F.col("limit_chars").isNull()).fillna(0, ["limit_chars", "limit_bytes"]))
    marks = {(r["source"], r["field"]): r["share"] for r in values.where(~F.col("free")).groupBy("source", "field").agg((F.sum(F.when(F.col("value").endswith("…"), F.col("n"))) / F.sum("n")).alias("share")).collect()}
    for x in found:
        x["marked"] = (marks.get((x["source"], x["field"])) or 0) > 0.05
    free = values.where("free")
    whole, pairs = _statistics(free)
    # training: a bounded sample of rows with intact values, chosen by a hash so that it is the same in every run
    intact = free.where("length(value) > 2").where(~F.col("value").endswith("…")).select("source", "field", "value", F.col("n").alias("own"))
    # of large tables only hashes up to a bound take part, about twice the sample
    sizes = {r["field"]: r["n"] for r in intact.groupBy("field").agg(F.sum("own").alias("n")).collect()}
    share = lambda f: min(1.0, 2 * SAMPLE / max(1, sizes.get(f, 0)))
    bound = F.coalesce(*(F.when(F.col("field") == f, 2 * share(f) - 1) for f in fields))
    drawn = long.withColumn("h", F.xxhash64("key", "field")).where(F.col("h") / float(2**63) <= bound)
    sample = drawn.join(intact, ["source", "field", "value"]).select("field", "value", "own", "h").toPandas()
    sample = sample.sort_values(["field", "h", "value", "own"], kind="stable").groupby("field").head(SAMPLE).reset_index(drop=True)
    facts: dict = {"limits": found, "trained_on": 0}
    base = values.select("source", "field", "value", "n", F.when(F.col("free"), F.col("n")).otherwise(0).alias("own"), F.lit(0).alias("own_longer"), "free", "limit_chars", "limit_bytes")
    examples = _cut_examples(sample, found, 7)
    if examples["label"].nunique() < 2:
        return base.select("source", "field", "value", "n", "free", F.lit(0.0).alias("p")), facts
    train = _with_counts(spark.createDataFrame(examples), whole, pairs).toPandas()
    train = train.sort_values(["field", "value", "limit_chars", "limit_bytes", "own", "own_longer", "label"], kind="stable").reset_index(drop=True)
    x, y = _feature_rows(train), train["label"].to_numpy(float)
    held = np.array([zlib.crc32(v.encode("utf-8", "surrogatepass")) % 10 == 0 for v in train["value"]])
    weights = fit([r for r, h in zip(x, held, strict=True) if not h], y[~held], train["weight"].to_numpy(float)[~held])
    p = np.array([1 / (1 + np.exp(-(weights[r].sum() + weights[DIMENSION]))) for r, h in zip(x, held, strict=True) if h])
    t = y[held]
    facts |= {"trained_on": int((~held).sum()), "held_out": int(held.sum()), "precision": float(t[p > 0.5].mean()) if (p > 0.5).any() else None, "recall": float((p[t == 1] > 0.5).mean())}
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # DIMENSION numbers, whatever the input

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for pdf in batches:
            z = np.array([w[r].sum() + w[DIMENSION] for r in _feature_rows(pdf)], float)
            yield pdf[["source", "field", "value", "n", "free"]].assign(z=np.where(pdf["value"] == "", -30.0, z) if len(pdf) else z)

    logits = cut(_with_counts(base, whole, pairs).mapInPandas(score, "source string, field string, value string, n long, free boolean, z double"))
    # sources break off more or less often than the training values: the shift of the log-odds that explains their scores
    loose = train[(train["limit_chars"] == 0) & (train["limit_bytes"] == 0)]
    prior = float((loose["weight"] * loose["label"]).sum() / loose["weight"].sum()) or 1e-4
    # transfers break off files, whatever the field: one share per source
    histogram = logits.where("free").groupBy("source", (F.round(F.col("z") * 4) / 4).alias("z")).agg(F.sum("n").alias("n")).toPandas()  # sources x score steps
    facts["shifts"] = {source: prior_shift(part["z"].to_numpy(), part["n"].to_numpy(), prior) for source, part in histogram.groupby("source")}
    shifts = spark.createDataFrame(list(facts["shifts"].items()), "source string, shift double")
    # recall on artificial broken transfers that the fit hasn't seen, under the shifts of the sources
    seen = train[held]
    broken = ((seen["label"] == 1) & (seen["limit_chars"] == 0) & (seen["limit_bytes"] == 0)).to_numpy()
    odds, weight = np.log(p / np.maximum(1 - p, 1e-12))[broken], histogram.groupby("source")["n"].sum()
    if broken.any():
        facts["broken_recall"] = {source: float(((odds + by) > 0).mean()) for source, by in facts["shifts"].items() if weight[source]}
    z = F.col("z") + F.when(F.col("free"), F.coalesce("shift", F.lit(0.0))).otherwise(0.0)
    return logits.join(shifts, "source", "left").select("source", "field", "value", "n", "free", (1 / (1 + F.exp(-z))).alias("p")), facts


def is_cut() -> Column:
    """Condition on the rows of `scored`."""
    return F.col("p") > THRESHOLD


def truncated_fields(rows: DataFrame, key: str, fields: list[str], source: str) -> DataFrame:
    """(key, field) of every value that `is_cut`."""
    hits = cut(scored(rows, key, fields, source)[0].where(is_cut()).select("source", "field", "value"))
    long = rows.select(F.col(key).alias("key"), _source(source), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("key", "source", "x.field", "x.value").where("value IS NOT NULL")
    return long.join(hits, ["source", "field", "value"], "left_semi").select("key", "field")
