"""Problem 3: text decoded with the wrong character encoding.

Method: a value is cut at blanks into chunks, and each distinct chunk is examined once. For every
legacy encoding the characters are mapped back to bytes, a byte-structure automaton finds the
maximal well-formed multibyte spans, and only those spans are decoded (again, for text garbled
twice). Text that went from one single-byte encoding through another has no such structure; for
it the same byte mapping proposes whole-chunk readings. Proposals are judged by how often their
words occur in the corpus, counted over all rows. Replacement characters and question marks inside
words mark text whose bytes are lost; it is restored where one word of the corpus fits and is commoner than all others together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import cut

# Encodings that programs wrongly read with, and encodings that files really had.
READERS = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "cp437", "cp850", "mac-roman", "cp866", "koi8-r", "cp1253"]
WRITERS = ["cp1252", "cp1250", "cp1251", "iso8859-2", "koi8-r", "cp866", "cp1253", "iso8859-7", "mac-roman", "cp437", "cp850"]
MULTIBYTE_WRITERS = ["cp932", "euc-jp"]
#: Text is garbled at most this many times over.
DEPTH = 3

#: Automaton over bytes (as code points 0..255): well-formed UTF-8 sequences of two to four bytes.
SPAN = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
SCHEMA = "chunk string, option int, restored string, strong boolean, words array<string>, old_words array<string>"


@lru_cache(maxsize=32)
def byte_map(encoding: str) -> dict[int, int]:
    """Character -> byte for the upper half of a single-byte encoding; undefined bytes map to themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


def to_bytes(text: str, encoding: str) -> str:
    """The text with each character replaced by its byte; characters without one become U+FFFF."""
    table = byte_map(encoding)
    return "".join(c if c < "\x80" else chr(table.get(ord(c), 0xFFFF)) for c in text)


def decode_spans(text: str, encoding: str) -> tuple[str, bool]:
    """Decode the well-formed multibyte spans of `text` as read by `encoding`; whether no other non-ASCII is left."""
    mapped, parts, last = to_bytes(text, encoding), [], 0
    for m in SPAN.finditer(mapped):
        try:
            new = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        parts += [text[last : m.start()], new]
        last = m.end()
    if not parts:
        return text, False
    rest = "".join(parts[::2]) + text[last:]
    return "".join(parts) + text[last:], rest.isascii()


def script(c: str) -> str:
    name = unicodedata.name(c, "").split(" ")[0]
    return "JAPANESE" if name in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA") else name


def plausible(text: str) -> bool:
    """Reads like ordinary text: words of one script, sane letter case, no symbols or controls."""
    previous = ""
    scripts: set[str] = set()
    for c in text:
        if c in "ªº" and previous.isalpha():
            return False
        if c.isalpha():
            scripts.add(script(c))
            if len(scripts) > 1 or (previous.islower() and c.isupper()):
                return False
        elif unicodedata.category(c)[0] == "M":
            pass
        else:
            scripts = set()
            if c > "\x7f" and c not in "¿¡«»‘’“”–—…、・。「」\u3000\xa0\xad":
                return False
        previous = c
    return True


def words(text: str) -> list[str]:
    """Lower-case runs of letters and marks."""
    out, run = [], []
    for c in text.lower() + " ":
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out


def odd_symbol(text: str) -> bool:
    """A symbol or control character stands between two letters, where no spelling has one."""
    for a, b, c in zip(text, text[1:], text[2:], strict=False):
        if b > "\x7f" and b < "　" and a.isalpha() and c.isalpha() and not b.isalpha() and (unicodedata.category(b) in ("Sm", "Sc", "So", "Sk", "No", "Cc") or b in "‰‚„†‡•¶§¿¡"):
            return True
    return any(0x80 <= ord(c) < 0xA0 or 0x2500 <= ord(c) < 0x25A0 for c in text)


def accented_run(text: str) -> bool:
    """At least four letters, all of them accented Latin: no language writes so, but shifted alphabets look so."""
    return bool(re.search("[À-ÿ]{4}", text))


def readings(chunk: str) -> dict[str, bool]:
    """Possible original texts of a chunk -> whether the evidence stands without the corpus."""
    out: dict[str, bool] = {}
    level = {chunk: True}
    for _ in range(DEPTH):
        found: dict[str, bool] = {}
        for text, whole in level.items():
            for reader in READERS:
                new, complete = decode_spans(text, reader)
                if new != text and not any("\x80" <= c < "\xa0" for c in new if c not in text):
                    found[new] = found.get(new, False) or (complete and whole)
        found = {k: v for k, v in found.items() if k not in out}
        for text, whole in found.items():
            if "�" in text or plausible(text):
                out[text] = out.get(text, False) or whole
        level = found
        if not level:
            break
    if "�" in chunk:
        return out
    for reader in READERS:
        mapped = to_bytes(chunk, reader)
        if "￿" in mapped:
            continue
        raw = mapped.encode("latin-1")
        for writer in [*WRITERS, *MULTIBYTE_WRITERS]:
            if writer == reader:
                continue
            try:
                new = raw.decode(writer)
            except UnicodeDecodeError:
                continue
            if new == chunk or new in out or not plausible(new) or not steady_case(new):
                continue
            if writer in MULTIBYTE_WRITERS:
                sure = odd_symbol(chunk) or not plausible(chunk)
                if all(script(c) == "JAPANESE" for c in new if c > "\x7f" and c.isalpha()) and not re.search("[｡-ﾟ]", new):
                    out[new] = sure
            else:
                ws = words(new)
                sure = accented_run(chunk) and bool(ws) and all(script(c) == "CYRILLIC" for w in ws for c in w) and writer == "cp1251" and reader in ("cp1252", "latin-1")
                out[new] = sure
    return out


def steady_case(text: str) -> bool:
    """Every word is in lower case, in upper case, or has a capital only at its start."""
    return all(w.islower() or w.isupper() or w[1:] == w[1:].lower() for w in re.findall(r"[^\W\d_]+", text))


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for chunk in batch["chunk"]:
            if "�" in chunk:
                rows.append((chunk, 0, None, True, [], []))
            body = chunk.rstrip("…")  # the mark of a cut value is no evidence
            options = {new + chunk[len(body) :]: sure for new, sure in readings(body).items()}
            before = words(chunk)
            old = [w for w in before if not w.isascii()]
            for i, (new, strong) in enumerate(options.items(), 1):
                if "�" in new:
                    rows.append((chunk, i, None, strong, [], old))
                else:
                    changed = [w for w in words(new) if w not in before]
                    rows.append((chunk, i, new, strong and (not plausible(chunk) or odd_symbol(chunk)), changed, old))
            if odd_symbol(chunk):
                rows.append((chunk, 99, None, True, [], old))
        yield pd.DataFrame(rows, columns=["chunk", "option", "restored", "strong", "words", "old_words"])


def _suspicious(name: str) -> Column:
    """Whether a text has a question mark or a character outside ASCII; told by its bytes, without a pattern over all rows."""
    text = F.col(f"`{name}`")
    return (F.octet_length(text) > F.length(text)) | text.contains("?") | ~F.is_valid_utf8(text)


def field_chunks(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, pos, chunk, pure): the blank-separated parts of the fields that may be garbled; `pure`: the value is ASCII."""
    suspicious = rows.where(reduce(Column.__or__, map(_suspicious, fields)))
    value = suspicious.select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("key", "x.field", "x.value").where(_suspicious("value"))
    pure = ~F.col("value").rlike(r"[^\x00-\x7F]")
    return value.select("key", "field", pure.alias("pure"), F.posexplode(F.split("value", "[ \t]")).alias("pos", "chunk")).where("chunk RLIKE '[^\\\\x00-\\\\x7F]|[?]'")


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(word, n): lower-case words with a non-ASCII letter, and how many rows of the corpus have them."""
    return chunks.where(F.col("chunk").rlike(r"[^\x00-\x7F]")).select("n", F.explode(F.regexp_extract_all(F.lower("chunk"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("word")).where(F.col("word").rlike(r"[^\x00-\x7F]")).groupBy("word").agg(F.sum("n").alias("n"))


def _masked(word: Column) -> Column:
    """Each word as it looks when its non-ASCII letters are lost: one mark a letter, or one a byte."""
    per_byte = F.regexp_replace(F.regexp_replace(word, r"[\u0080-߿]", "??"), r"[^\x00-\x7F]", "???")
    return F.array_distinct(F.array(F.regexp_replace(word, r"[^\x00-\x7F]", "?"), per_byte))


def verdicts(counted: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(chunk, restored, lossy) for garbled chunks of `counted` (chunk, n); `restored` is null where unknown.

    `more` adds (chunk, n) of other columns to the corpus the words are counted in. A chunk is garbled if
    a reading stands on structure alone (no ordinary text looks like the chunk), if the words of a
    reading are known and commoner, if a symbol stands between letters, or if characters are lost.
    """
    counted = cut(counted)
    corpus = vocabulary(counted if more is None else counted.unionByName(more))
    corpus = cut(corpus)
    non_ascii = counted.where(F.col("chunk").rlike(r"[^\x00-\x7F]"))
    options = cut(non_ascii.select("chunk").repartition(max(8, counted.rdd.getNumPartitions())).mapInPandas(_candidates, SCHEMA))
    known = corpus.select(F.col("word").alias("w"), F.col("n").alias("known"))
    new = options.select("chunk", "option", F.explode("words").alias("w")).join(known, "w", "left").groupBy("chunk", "option").agg(F.min(F.coalesce("known", F.lit(0))).alias("new_n"))
    old = options.select("chunk", F.explode("old_words").alias("w")).distinct().join(known, "w", "left").groupBy("chunk").agg(F.min(F.coalesce("known", F.lit(0))).alias("old_n"))
    judged = options.join(new, ["chunk", "option"], "left").join(old, "chunk", "left").fillna(0, ["new_n", "old_n"])
    lost = F.col("restored").isNull()
    good = judged.where((F.col("strong")) | (~lost & (F.col("new_n") > F.col("old_n")) & (F.col("new_n") > 1) & F.exists("words", lambda w: F.length(w) > 2)))
    found = good.groupBy("chunk").agg(F.max_by("restored", F.when(lost, -1).otherwise(F.col("new_n") + F.col("strong").cast("int"))).alias("restored"))
    # lost characters: question marks inside words, and replacement characters
    marked = counted.where(F.col("chunk").contains("?") | F.col("chunk").contains("�"))
    pattern = F.regexp_extract_all(F.lower(F.translate("chunk", "�", "?")), F.lit(r"[\p{L}\p{M}?]+"), F.lit(0))
    holes = marked.select("chunk", F.explode(F.filter(pattern, lambda w: w.contains("?"))).alias("mask")).distinct()
    fits = corpus.select("word", "n", F.explode(_masked(F.col("word"))).alias("mask")).join(holes.select("mask").distinct(), "mask", "left_semi")
    fits = fits.groupBy("mask").agg(F.max_by("word", "n").alias("word"), (2 * F.max("n") > F.sum("n")).alias("clear"))
    filled = holes.join(fits, "mask", "left")
    inner = F.col("mask").rlike(r"\p{L}[?]+\p{L}") | F.col("mask").rlike(r"^[?]+$") & (F.length("mask") > 1)
    question = filled.groupBy("chunk").agg(F.bool_or(inner).alias("inner"), F.bool_or(F.col("word").isNotNull()).alias("fit"), F.count("*").alias("holes"), F.max("word").alias("word"), F.bool_and("clear").alias("clear"), F.max("mask").alias("mask"))
    question = question.where(F.col("chunk").contains("�") | (~F.col("chunk").rlike(r"[^\x00-\x7F]") & (F.col("inner") | F.col("fit"))))
    one = (F.col("holes") == 1) & F.col("clear")
    shaped = F.when(F.col("chunk") == F.upper("chunk"), F.upper("word")).when(F.substring("chunk", 1, 1).rlike(r"[\p{Lu}?\x{FFFD}]"), F.initcap("word")).otherwise(F.col("word"))
    whole = F.concat(F.expr("substr(chunk, 1, instr(lower(translate(chunk, '�', '?')), mask) - 1)"), shaped, F.expr("substr(chunk, instr(lower(translate(chunk, '�', '?')), mask) + length(mask))"))
    question = question.select("chunk", F.when(one, whole).alias("filled"))
    both = found.select("chunk", "restored", F.lit(False).alias("lossy")).join(question, "chunk", "full")
    return both.select("chunk", F.coalesce("restored", "filled").alias("restored"), F.coalesce("lossy", F.lit(True)).alias("lossy"))


def garbled_fields(rows: DataFrame, key: str, fields: list[str], more: list[tuple[DataFrame, list[str]]] = ()) -> DataFrame:
    """(key, field, restored): the garbled values of `fields`, and the value restored as far as it can be known.

    `restored` is null if a garbled part of the value can't be restored. Null and empty values are never
    garbled; equal values get equal results; other columns are ignored; an empty table gives no rows.
    `more` names further (rows, fields) whose words count as corpus.
    """
    chunks = field_chunks(rows, key, fields)
    counted = chunks.groupBy("chunk").agg(F.count("*").alias("n"))
    extra = None
    for table, names in more:
        part = field_chunks(table.withColumn("key_", F.lit(0)), "key_", names).groupBy("chunk").agg(F.count("*").alias("n"))
        extra = part if extra is None else extra.unionByName(part)
    verdict = cut(verdicts(counted, extra))
    # a lone question mark at the end of a word counts only in a value that is ASCII otherwise
    hit = chunks.join(verdict, "chunk").where("NOT lossy OR pure OR chunk LIKE '%�%'")
    per_value = hit.groupBy("key", "field").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.coalesce("restored", F.lit("�"))))).alias("parts"))
    return per_value


def restore(rows: DataFrame, key: str, fields: list[str], found: DataFrame) -> DataFrame:
    """(key, field, value, restored) from the result of `garbled_fields`; untouched parts of a value stay as they are."""
    value = rows.select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("key", "x.field", "x.value")
    joined = value.join(found, ["key", "field"])
    parts = F.transform(F.split("value", "[ \t]"), lambda x, i: F.coalesce(F.try_element_at("parts", i), x))
    text = F.array_join(parts, " ")
    return joined.select("key", "field", "value", F.when(~text.contains("�"), text).alias("restored"))
