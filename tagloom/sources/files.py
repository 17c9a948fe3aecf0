"""Files as tables: listing with identities, and tags, pictures and fingerprints parsed from their headers.

Contents come from the `binaryFile` source in Arrow batches; a broken file gives a status, never an error.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File name endings of audio files.
AUDIO = ["mp3", "flac", "m4a", "mp4", "ogg", "oga", "opus", "wav", "wave", "aif", "aiff", "wv"]
LISTING = "path string, size long, mtime_ns long, ctime_ns long, dev long, ino long, kind string"


def listing(spark: SparkSession, root: str, journal_mark: str = ".artwork-transaction-") -> DataFrame:
    """(path, size, mtime_ns, ctime_ns, dev, ino, kind) of a local folder: `audio` files and `journal` leftovers.

    Symbolic and hard links, other file types, and anything below a name that begins with a dot are left out
    (journals excepted). Folders below `root` are walked by the executors, one task each.
    """
    tops = [root, *(e.path for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and not e.name.startswith("."))]
    seeds = spark.createDataFrame([(t, t == root) for t in tops], "top string, flat boolean").repartition(min(len(tops), 200))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for start, flat in zip(pdf["top"], pdf["flat"], strict=True):
                for folder, folders, names in os.walk(start):
                    folders[:] = [] if flat else sorted(f for f in folders if not f.startswith(".") and not os.path.islink(os.path.join(folder, f)))
                    for name in sorted(names):
                        path = os.path.join(folder, name)
                        info = os.lstat(path)
                        journal = name.startswith(".") and journal_mark in name and name.endswith(".json")
                        if not os.path.isfile(path) or os.path.islink(path) or info.st_nlink != 1 or (name.startswith(".") and not journal):
                            continue
                        if journal or name.rpartition(".")[2].lower() in AUDIO:
                            rows.append((path, info.st_size, info.st_mtime_ns, info.st_ctime_ns, info.st_dev, info.st_ino, "journal" if journal else "audio"))
            yield pd.DataFrame(rows, columns=["path", "size", "mtime_ns", "ctime_ns", "dev", "ino", "kind"])

    return seeds.mapInPandas(walk, LISTING)


def _vorbis(data: bytes) -> dict[str, list[str]]:
    tags: dict[str, list[str]] = {}
    at = 4 + struct.unpack_from("<I", data, 0)[0]
    (count,) = struct.unpack_from("<I", data, at)
    at += 4
    for _ in range(count):
        (n,) = struct.unpack_from("<I", data, at)
        key, _, value = data[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        tags.setdefault(key.lower(), []).append(value)
        at += 4 + n
    return tags


def _picture(data: bytes) -> tuple[int, str, bytes]:
    kind, n = struct.unpack_from(">II", data, 0)
    mime = data[8 : 8 + n].decode("ascii", "replace")
    (d,) = struct.unpack_from(">I", data, 8 + n)
    at = 12 + n + d + 16
    (size,) = struct.unpack_from(">I", data, at)
    return kind, mime, data[at + 4 : at + 4 + size]


def parse_flac(data: bytes) -> dict:
    """Tags, duration, front picture and the digest of the audio frames of a FLAC stream."""
    at, tags, ms, front, last = 4, {}, None, None, False
    while not last:
        head, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("cut off")
        last, kind = bool(head & 0x80), head & 0x7F
        if kind == 0:
            rate = int.from_bytes(body[10:13], "big") >> 4
            samples = int.from_bytes(body[13:18], "big") & ((1 << 36) - 1)
            ms = round(samples * 1000 / rate) if rate and samples else None
        elif kind == 4:
            tags = _vorbis(body)
        elif kind == 6:
            number, mime, image = _picture(body)
            front = (mime, image) if number == 3 else front
        at += 4 + size
    return {"container": "flac", "tags": tags, "duration_ms": ms, "front": front, "audio": data[at:]}


# ID3 frames and the tags they hold.
FRAMES = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TPE2": "albumartist", "TDRC": "date", "TYER": "date", "TRCK": "tracknumber", "TPOS": "discnumber"}


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | (b[3] & 127)


def _id3_text(body: bytes) -> list[str]:
    codec = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] if body and body[0] < 4 else 0]
    return [x for x in body[1:].decode(codec, "replace").split("\0") if x]


def parse_id3(data: bytes) -> dict:
    """Tags and front picture of an ID3v2.3/2.4 header; the audio is what lies between it and an ID3v1 trailer."""
    version, end = data[3], 10 + _syncsafe(data[6:10])
    if version not in (3, 4):
        raise ValueError("unsupported version")
    at, tags, front = 10, {}, None
    while at + 10 <= end and data[at] != 0:
        name = data[at : at + 4].decode("ascii", "replace")
        size = _syncsafe(data[at + 4 : at + 8]) if version == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + size]
        if name in FRAMES:
            tags.setdefault(FRAMES[name], []).extend(_id3_text(body))
        elif name == "TXXX" and len(parts := _id3_text(body)) > 1:
            tags.setdefault(parts[0].lower(), []).extend(parts[1:])
        elif name == "APIC":
            mime, _, rest = body[1:].partition(b"\0")
            if rest[:1] == b"\x03":
                wide = body[0] in (1, 2)
                cutoff = rest.find(b"\0\0" if wide else b"\0", 1) + (2 if wide else 1)
                front = (mime.decode("ascii", "replace"), rest[cutoff:])
        at += 10 + size
    stop = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    return {"container": "id3", "tags": tags, "duration_ms": None, "front": front, "audio": data[end:stop]}


def parse_riff(data: bytes) -> dict:
    """Duration, INFO tags and the data chunk of a WAVE file."""
    names = {b"INAM": "title", b"IART": "artist", b"IPRD": "album", b"ICRD": "date", b"ITRK": "tracknumber"}  # fixed values
    at, tags, rate, audio = 12, {}, 0, b""
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            rate = int.from_bytes(body[8:12], "little")
        elif kind == b"data":
            audio = body
        elif kind == b"LIST" and body[:4] == b"INFO":
            k = 4
            while k + 8 <= len(body):
                n = int.from_bytes(body[k + 4 : k + 8], "little")
                if body[k : k + 4] in names:
                    tags.setdefault(names[body[k : k + 4]], []).append(body[k + 8 : k + 8 + n].rstrip(b"\0").decode("utf-8", "replace"))
                k += 8 + n + n % 2
        at += 8 + size + size % 2
    return {"container": "riff", "tags": tags, "duration_ms": round(len(audio) * 1000 / rate) if rate else None, "front": None, "audio": audio}


def image_header(data: bytes) -> tuple[str, int, int, int] | None:
    """(mime, width, height, bits per pixel) of a PNG or JPEG header; None for anything else or cut headers."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 26:
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(data[25], 0)
        return ("image/png", *struct.unpack_from(">II", data, 16), data[24] * channels)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", data, at + 5)
                return "image/jpeg", width, height, data[at + 4] * data[at + 9]
            at += 2 + size
    return None


def parse(data: bytes) -> dict:
    if data[:4] == b"fLaC":
        return parse_flac(data)
    if data[:3] == b"ID3":
        return parse_id3(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return parse_riff(data)
    raise ValueError("unknown container")


PARSED = "path string, status string, container string, tags map<string,array<string>>, duration_ms long, audio_bytes long, audio_sha256 string, picture_mime string, picture_width int, picture_height int, picture_depth int, picture_sha256 string"


def read_tags(files: DataFrame) -> DataFrame:
    """Tags, fingerprints and the front picture of each file of a `binaryFile` table (path, content).

    `status` is `ok` or says why a file can't be read. Xiph pictures in base64 tags count as front pictures.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    x = parse(bytes(content))
                except (ValueError, IndexError, struct.error, UnicodeError) as error:
                    rows.append((path, str(error) or type(error).__name__, *[None] * 10))
                    continue
                front = x["front"]
                for block in x["tags"].pop("metadata_block_picture", []):
                    kind, mime, image = _picture(base64.b64decode(block))
                    front = (mime, image) if kind == 3 and front is None else front
                head = image_header(front[1]) if front else None
                picture = (*(head or (front[0], None, None, None)), hashlib.sha256(front[1]).hexdigest()) if front else (None,) * 5
                rows.append((path, "ok", x["container"], x["tags"], x["duration_ms"], len(x["audio"]), hashlib.sha256(x["audio"]).hexdigest(), *picture))
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PARSED.split(", ")])
            for c in ("duration_ms", "audio_bytes", "picture_width", "picture_height", "picture_depth"):
                out[c] = out[c].astype("Int64")
            yield out

    return files.select("path", "content").mapInPandas(run, PARSED)


def tag(tags, *names: str):
    """First non-empty value among the names of a tag map, in their order."""
    lists = F.flatten(F.array(*(F.coalesce(F.try_element_at(tags, F.lit(n)), F.array().cast("array<string>")) for n in names)))
    return F.try_element_at(F.filter(lists, lambda v: F.trim(v) != ""), F.lit(1))


def identifier(tags, names: list[str], valid, key):
    """struct<value,warnings> of an identifier tag: null and a warning if several different ones are valid, a warning for malformed ones."""
    raw = F.filter(F.flatten(F.array(*(F.coalesce(F.try_element_at(tags, F.lit(n)), F.array().cast("array<string>")) for n in names))), lambda v: F.trim(v) != "")
    good = F.array_compact(F.transform(raw, valid))
    distinct = F.array_distinct(F.transform(good, key))
    warnings = F.array_compact(F.array(F.when(F.size(good) < F.size(raw), "malformed"), F.when(F.size(distinct) > 1, "conflict")))
    return F.struct(F.when(F.size(distinct) == 1, F.try_element_at(good, F.lit(1))).alias("value"), warnings.alias("warnings"))
