"""vCard 3.0 files as DataFrames, and back.

``read_vcards`` reads whole files through Spark's own reader, so any store that Spark reads will do; a card is a row. A
card that does not end, or absorbs others, becomes a warning and never ends the read. ``VCardSource`` offers the same
as ``spark.read.format("vcard")`` for paths that Python can open. Text is decoded except organisations, photo URIs and
extra properties, which stay in wire form.
"""

from __future__ import annotations

import base64
import binascii
import os
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinfold import model as M
from kinfold.functions import text as X
from kinfold.plans.storage import materialize

# Characters that are dropped from values, and the properties that have columns of their own.
CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f​‎‏‪-‮⁠-⁤⁦-⁩﻿]")
MODELED = {"BEGIN", "END", "VERSION", "N", "FN", "EMAIL", "TEL", "ORG", "TITLE", "BDAY", "ADR", "NOTE", "URL", "PHOTO", "PRODID", "REV"}
PLATFORMS = ("icloud", "google")
_BETWEEN = re.compile(rb"(?:^|\n)END:VCARD[ \t]*\r?\n(?=BEGIN:VCARD)", re.I)
_PARAM = re.compile(r';([^=;:]+)(?:=("[^"]*"|[^;:]*))?')


@dataclass
class Property:
    name: str
    params: dict[str, list[str]]
    value: str

    def param(self, name: str) -> str:
        return next(iter(self.params.get(name, [])), "")


@dataclass
class Card:
    properties: list[Property] = field(default_factory=list)

    def all(self, name: str) -> list[Property]:
        return [p for p in self.properties if p.name == name]

    def preferred(self, name: str) -> Property | None:
        """The lowest PREF, else one of TYPE pref, else the first."""

        def order(p: Property) -> int:
            pref = p.param("PREF")
            return int(pref) if re.fullmatch("[0-9]+", pref) else 0 if any("pref" in v.lower().split(",") for v in p.params.get("TYPE", [])) else 1000

        return min(self.all(name), key=order, default=None)

    def text(self, name: str) -> str:
        p = self.preferred(name)
        return unescape(p.value) if p else ""


def units(value: str, separator: str = ";") -> list[str]:
    """Split at separators that no backslash escapes."""
    out, at, i = [], 0, 0
    while i < len(value):
        if value[i] == "\\":
            i += 1
        elif value[i] == separator:
            out.append(value[at:i])
            at = i + 1
        i += 1
    return [*out, value[at:]]


def unescape(value: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] in "nN" else m[1], value, flags=re.S)


def escape(value: str) -> str:
    return re.sub(r"[\\;,]", r"\\\g<0>", value).replace("\n", r"\n")


def parse_line(line: str) -> Property | None:
    m = re.match(r"(?:[^:;.]+\.)?([A-Za-z0-9-]+)", line)
    if not m:
        return None
    at, params = m.end(), {}
    while at < len(line) and line[at] == ";":
        p = _PARAM.match(line, at)
        if not p:
            return None
        key = p[1].strip().upper()
        values = CONTROL.sub("", (p[2] or "").strip('"')).split(",") if p[2] is not None else [p[1].strip()]
        params.setdefault(key if p[2] is not None else "TYPE", []).extend(values)
        at = p.end()
    return Property(m[1].upper(), params, CONTROL.sub("", line[at + 1 :])) if line[at : at + 1] == ":" else None


def cards(text: str) -> Iterator[tuple[int, Card | None, str]]:
    """``(number, card, warning)`` of the cards in a file; either is set."""
    number, card, absorbed = 0, None, 0
    for line in re.split(r"\r?\n", re.sub(r"\r?\n[ \t]", "", text.removeprefix("﻿"))):
        head = line.strip().upper()
        if head == "BEGIN:VCARD":
            if card is None:
                card, absorbed = Card(), 0
            else:
                absorbed += 1
        elif head == "END:VCARD" and card is not None:
            if absorbed:
                yield number, None, f"card has no END; the {absorbed} card(s) it absorbed were skipped"
            else:
                yield number, card, ""
            number, card = number + 1 + absorbed, None
        elif card is not None and line.strip():
            p = parse_line(line)
            if p is not None:
                card.properties.append(p)
    if card is not None:
        yield number, None, "card has no END"


def provenance(value: str, source: str) -> list[str]:
    """Sources that a written card names: one platform, or ``merged(a+b)``; anything else is the card's own source."""
    value = value.strip()
    inner = re.fullmatch(r"merged\((.*)\)", value, re.S)
    names = [n.strip() for n in (inner[1] if inner else value).split("+")]
    return list(dict.fromkeys(names)) if names and all(n in PLATFORMS for n in names) else [source]


def to_row(card: Card, source: str, idx: int) -> dict:
    """A card's columns; ``birthday`` still as written, with ``omit_year`` of the parameter that marks a placeholder."""
    own = next((p.value for p in card.properties if p.name.startswith("X-") and p.name.endswith("-SOURCE")), "")
    if source not in PLATFORMS and own in PLATFORMS:
        source = own
    n = ([unescape(u).strip() for u in units(card.all("N")[0].value)] if card.all("N") else [])[:5]
    family, given, middle, prefix, suffix = n + [""] * (5 - len(n))
    addresses = []
    for p in card.all("ADR"):
        parts = [unescape(u).strip() for u in units(p.value)][:7]
        pobox, extended, street, city, region, postcode, country = parts + [""] * (7 - len(parts))
        if any(parts):
            addresses.append({"type": p.param("TYPE").upper(), "street": street, "city": city, "region": region, "postcode": postcode, "country": country, "pobox": pobox, "extended": extended})
    org = card.preferred("ORG")
    bday = card.preferred("BDAY")
    row = {
        "idx": idx, "source": source, "family_name": family, "given_name": given, "middle_name": middle, "prefix": prefix, "suffix": suffix, "formatted_name": card.text("FN"),
        "emails": [{"address": unescape(p.value), "type": p.param("TYPE").upper()} for p in card.all("EMAIL") if p.value],
        "phones": [{"number": unescape(p.value), "type": p.param("TYPE").upper()} for p in card.all("TEL") if p.value],
        "org": re.sub(";+$", "", ";".join(u.strip() for u in units(org.value))) if org else "", "title": card.text("TITLE"),
        "birthday": unescape(bday.value).strip() if bday else "", "omit_year": bday.param("X-APPLE-OMIT-YEAR") if bday else "",
        "addresses": addresses, "note": card.text("NOTE"), "url": card.text("URL"), "photo": None, "photo_uri": "", "photo_type": "", "extra": {},
    }
    for p in card.all("PHOTO")[:1]:
        row["photo_type"], value = p.param("TYPE"), p.value.strip()
        if p.param("ENCODING").lower() in ("b", "base64"):
            try:
                row["photo"] = base64.b64decode(p.value, validate=True)
            except (binascii.Error, ValueError):
                pass
        elif p.param("VALUE").lower() == "uri" or re.match("(https?://|data:)", value, re.I):
            row["photo_uri"] = value
        elif value:
            row["photo"] = p.value.encode()
    for p in card.properties:
        if p.name not in MODELED:
            row["extra"].setdefault(p.name, []).append(p.value)
    return row


#: Contacts and warnings in one table: ``kind`` tells which, ``card`` is the physical card's number in its ``file`` (and
#: ``chunk`` of it).
PARSED = T.StructType([T.StructField("file", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("card", T.IntegerType()), T.StructField("warning", T.StringType()), T.StructField("omit_year", T.StringType()), *M.CONTACT.fields])


def parsed_rows(text: str, source: str, file: str = "", chunk: int = 0) -> Iterator[tuple]:
    """Rows of ``PARSED``; malformed cards take no contact index, which counts from 0 in each chunk."""
    idx, place = 0, {"file": file, "chunk": chunk}
    for number, card, warning in cards(text):
        row: dict = place | {"kind": "warning", "card": number, "warning": warning}
        if card is not None:
            row = place | {"kind": "contact", "card": number, "warning": ""} | to_row(card, source, idx)
            idx += 1
        yield tuple(row.get(f.name) for f in PARSED.fields)


def _finished(parsed: DataFrame) -> DataFrame:
    """Readable birthdays, without years that only mark a place."""
    day = X.birthday(F.col("birthday"))
    marked = (F.col("omit_year") != "") & day.startswith(F.concat("omit_year", F.lit("-")))
    return parsed.withColumn("birthday", F.when(marked, X.birthday_without_year(day)).otherwise(day)).drop("omit_year")


def numbered(parsed: DataFrame) -> DataFrame:
    """``PARSED`` rows with ``idx`` and ``card`` counted over all files, in the order of their paths and chunks. Only a
    row a chunk is gathered."""
    sizes = parsed.groupBy("file", "chunk").agg(F.count_if(F.col("kind") == "contact").alias("contacts"), (F.max("card") + 1).alias("cards"))
    before = Window.orderBy("file", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "chunk", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in ("contacts", "cards")))
    out = parsed.join(F.broadcast(starts), ["file", "chunk"])
    return out.withColumns({"idx": (F.col("idx") + F.col("contacts_before")).cast("int"), "card": (F.col("card") + F.col("cards_before")).cast("int")}).select(*parsed.columns)


def parse_files(spark: SparkSession, path: str, source: str = "unknown") -> DataFrame:
    """``PARSED`` rows of all files at ``path``, read by Spark and parsed once; a file is one task's work. For larger
    files see ``parse_large``."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for file, text in zip(pdf["file"], pdf["value"], strict=True) for r in parsed_rows(text, source, file)]
            yield pd.DataFrame(rows, columns=[f.name for f in PARSED.fields])

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return numbered(materialize(_finished(texts.mapInPandas(run, PARSED)), "parsed"))


def parse_large(spark: SparkSession, path: str, source: str = "unknown", chunk_bytes: int = 64 << 20) -> DataFrame:
    """As ``parse_files``, with files cut between cards in chunks of about ``chunk_bytes``, a task each; for paths that
    Python can open on every executor."""
    spark.dataSource.register(VCardSource)
    rows = spark.read.format("vcard").option("source", source).option("chunkBytes", str(chunk_bytes)).load(path)
    return numbered(materialize(_finished(rows), "parsed"))


def parse_cards(lines: DataFrame, source: str = "unknown") -> DataFrame:
    """Contacts of ``idx, value``: texts of one card each, which keep their ``idx``; texts without a whole card are left out."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [r for i, text in zip(pdf["idx"], pdf["value"], strict=True) for card in [next((c for _, c, _ in cards(text) if c), None)] if card for r in [to_row(card, source, i)]]
            yield pd.DataFrame([tuple(r.get(n) for n in [f.name for f in PARSED.fields]) for r in rows], columns=[f.name for f in PARSED.fields])

    return _finished(lines.select("idx", "value").mapInPandas(run, PARSED)).select(*[f.name for f in M.CONTACT.fields])


def contacts(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'contact'").select(*[f.name for f in M.CONTACT.fields])


def warnings(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'warning'").select("file", "card", "warning")


def read_vcards(spark: SparkSession, path: str, source: str = "unknown") -> DataFrame:
    """The contacts of one export."""
    return contacts(parse_files(spark, path, source))


def concat_sources(*exports: DataFrame) -> DataFrame:
    """Exports after each other; indexes go on from one to the next, in the order given."""
    offset, parts = 0, []
    for export in exports:
        parts.append(export.withColumn("idx", (F.col("idx") + offset).cast("int")))
        offset += export.count()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class VCardSource(DataSource):
    """``spark.read.format("vcard").option("source", "icloud").load(path)``: contacts, birthdays as written."""

    @classmethod
    def name(cls) -> str:
        return "vcard"

    def schema(self) -> T.StructType:
        return PARSED

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("source", "unknown"), int(self.options.get("chunkbytes", self.options.get("chunkBytes", 64 << 20))))


class _Reader(DataSourceReader):
    def __init__(self, path: str, source: str, chunk: int) -> None:
        self.path, self.source, self.chunk = path.removeprefix("file://"), source, chunk

    def partitions(self) -> list[InputPartition]:
        names = [os.path.join(self.path, n) for n in sorted(os.listdir(self.path)) if n.endswith(".vcf")] if os.path.isdir(self.path) else [self.path]
        return [InputPartition((n, at)) for n in names for at in range(0, max(1, os.path.getsize(n)), self.chunk)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, at = partition.value
        with open(name, "rb") as f:
            begin, end = next_card(f, at), next_card(f, at + self.chunk)
            f.seek(begin)
            text = f.read(end - begin).decode("utf-8", "replace")
        if text:
            yield from parsed_rows(text, self.source, name, at)


def next_card(f: BinaryIO, at: int, step: int = 1 << 20) -> int:
    """The first place from ``at`` on where a card begins right behind the END of another; 0 for 0, else the file's end."""
    size = f.seek(0, os.SEEK_END)
    if at == 0:
        return 0
    overlap = 64
    while at < size:
        f.seek(max(0, at - overlap))
        found = _BETWEEN.search(f.read(step + 2 * overlap))
        while found and max(0, at - overlap) + found.end() < at:
            f.seek(max(0, at - overlap))
            found = _BETWEEN.search(f.read(step + 2 * overlap), found.end())
        if found:
            return max(0, at - overlap) + found.end()
        at += step
    return size


def _line(name: str, value: str, params: str = "") -> tuple[str, str]:
    return name, f"{name}{params}:{value}"


def format_card(c: dict, sources: list[str] | None = None, score: float = 0.0, review: bool = False, cluster: str = "", prefix: str = M.EXTENSION) -> str:
    """One card in wire form: properties by name, CRLF, no folding. Stale provenance is replaced."""

    def typed(t: str | None) -> str:
        return ";TYPE=" + re.sub(r"[\\,]", r"\\\g<0>", t).replace("\n", r"\n") if t else ""

    fn = c["formatted_name"] or " ".join(x for x in (c["given_name"], c["family_name"]) if x) or "Unknown"
    lines = [_line("FN", escape(fn)), _line("N", ";".join(escape(c[k] or "") for k in ("family_name", "given_name", "middle_name", "prefix", "suffix")))]
    lines += [_line("EMAIL", escape(e["address"]), typed(e["type"])) for e in c["emails"] or []]
    lines += [_line("TEL", escape(p["number"]), typed(p["type"])) for p in c["phones"] or []]
    lines += [_line("ADR", ";".join(escape(a[k] or "") for k in ("pobox", "extended", "street", "city", "region", "postcode", "country")), typed(a["type"])) for a in c["addresses"] or []]
    lines += [_line(n, v) for n, v in (("ORG", c["org"]), ("TITLE", escape(c["title"] or "")), ("BDAY", escape(c["birthday"] or "")), ("NOTE", escape(c["note"] or "")), ("URL", escape(c["url"] or ""))) if v]
    if c["photo"]:
        lines.append(_line("PHOTO", base64.b64encode(c["photo"]).decode(), ";ENCODING=b" + typed(c["photo_type"])))
    elif c["photo_uri"]:
        lines.append(_line("PHOTO", c["photo_uri"], ";VALUE=uri" + typed(c["photo_type"])))
    drop = {f"{prefix}-SOURCE"} | ({f"{prefix}-SCORE"} if score > 0 else set()) | ({f"{prefix}-REVIEW"} if review else set()) | ({f"{prefix}-CLUSTER"} if cluster else set())
    lines += [_line(k, v) for k in sorted(c["extra"] or {}) if k not in drop for v in c["extra"][k]]
    names = sources or [c["source"]]
    if len(names) > 1:
        lines.append(_line(f"{prefix}-SOURCE", f"merged({'+'.join(names)})"))
    elif names[0] in PLATFORMS:
        lines.append(_line(f"{prefix}-SOURCE", names[0]))
    if score > 0:
        lines.append(_line(f"{prefix}-SCORE", f"{score:.2f}"))
    if review:
        lines.append(_line(f"{prefix}-REVIEW", "true"))
    if cluster:
        lines.append(_line(f"{prefix}-CLUSTER", cluster))
    body = [text for _, text in sorted(lines, key=lambda x: x[0])]
    return "\r\n".join(["BEGIN:VCARD", "VERSION:3.0", *body, "END:VCARD"]) + "\r\n"


def card_lines(contacts: DataFrame, review: bool = False) -> DataFrame:
    """``idx, value``: the cards of contacts (with ``sources``, ``score`` and ``cluster_id`` where there are such columns)."""
    has = set(contacts.columns)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                r |= {k: [dict(x) for x in (r[k] if r[k] is not None else [])] for k in ("emails", "phones", "addresses")}
                r["extra"] = {k: list(v) for k, v in (dict(r["extra"]) if r["extra"] is not None else {}).items()}
                sources = list(r["sources"]) if "sources" in has else None
                out.append((r["idx"], format_card(r, sources, float(r["score"]) if "score" in has else 0.0, review, r["cluster_id"] if review and "cluster_id" in has else "")))
            yield pd.DataFrame(out, columns=["idx", "value"])

    return contacts.mapInPandas(run, "idx int, value string")


def write_vcards(contacts: DataFrame, path: str, review: bool = False) -> None:
    """A folder of vCard parts in index order; Spark's committer makes it appear at once."""
    card_lines(contacts, review).repartitionByRange("idx").sortWithinPartitions("idx").select("value").write.mode("overwrite").option("lineSep", "").text(path)


def stage_file(contacts: DataFrame, path: str, review: bool = False) -> str:
    """Write one local file beside its target, under a name that nobody else takes; the name. Rows reach the driver
    partition by partition. Nothing is left behind if it fails."""
    if os.path.isdir(path):
        raise IsADirectoryError(path)
    handle, staged = tempfile.mkstemp(prefix=f".{os.path.basename(path)}.", suffix=".tmp", dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            for r in card_lines(contacts, review).orderBy("idx").toLocalIterator():
                f.write(r["value"])
            f.flush()
            os.fsync(f.fileno())
    except BaseException:
        os.unlink(staged)
        raise
    return staged


def write_file(contacts: DataFrame, path: str, review: bool = False) -> None:
    """One local file, for exports that address books import: written beside the target and renamed over it."""
    os.replace(stage_file(contacts, path, review), path)
