"""The extraction operator: modules run per row in Arrow batches; a bad row becomes an error row, never a failed job.

A module is a function (content, info) -> Resource. Single-valued properties keep the first value set, multi-valued ones
collect. Nested entities are children with a stable identifier made of the parent and their position.
"""

from __future__ import annotations

import hashlib
import importlib
import signal
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_TEXT = 1 << 20
DEADLINE = 5.0
SCHEMA = (
    "url string, mime_type string, module string, rdf_types array<string>, title string, plain_text string, "
    "props map<string,array<string>>, children array<struct<id:string,kind:string,position:int,props:map<string,string>>>, error string"
)


@dataclass
class Info:
    """What a module is told about a file."""

    url: str = ""
    mime: str = ""
    max_text: int = MAX_TEXT
    sidecars: dict[str, bytes] = field(default_factory=dict)


@dataclass
class Resource:
    """Properties and nested entities of one interpretation."""

    props: dict[str, list[str]] = field(default_factory=dict)
    children: list[tuple[str, int, dict[str, str]]] = field(default_factory=list)
    types: list[str] = field(default_factory=list)

    def set(self, name: str, value: object) -> None:
        """The first value that isn't blank wins."""
        if value is not None and name not in self.props and (text := _text(value)):
            self.props[name] = [text]

    def add(self, name: str, value: object) -> None:
        """One more value, without repeats."""
        if value is not None and (text := _text(value)) and text not in self.props.get(name, []):
            self.props.setdefault(name, []).append(text)

    def get(self, name: str) -> str | None:
        return self.props.get(name, [None])[0]

    def child(self, kind: str, position: int, **props: object) -> None:
        self.children.append((kind, position, {k.replace("__", ":"): t for k, v in props.items() if v is not None and (t := _text(v))}))


class Unreadable(ValueError):
    """The content is not what its type says."""


def _text(value: object) -> str:
    if isinstance(value, float):
        return f"{value:.10g}"
    return str(value).replace("\x00", "").strip()


def limit_text(text: str, max_bytes: int) -> str:
    """At most so many bytes of UTF-8, cut between characters."""
    data = text.encode("utf-8", "replace")
    return text if len(data) <= max_bytes else data[:max_bytes].decode("utf-8", "ignore")


#: module -> (python module, function)
MODULES: dict[str, tuple[str, str]] = {
    "text": ("documents", "text"),
    "html": ("documents", "html"),
    "ps": ("documents", "postscript"),
    "pdf": ("pdf", "pdf"),
    "abw": ("documents", "abiword"),
    "epub": ("zipped", "epub"),
    "oasis": ("zipped", "oasis"),
    "msoffice-xml": ("zipped", "msoffice_xml"),
    "xps": ("zipped", "xps"),
    "msoffice": ("ole", "msoffice"),
    "desktop": ("documents", "desktop"),
    "playlist": ("playlists", "playlist"),
    "disc-generic": ("playlists", "disc"),
    "iso": ("playlists", "iso"),
    "mp3": ("audio", "mp3"),
    "libav": ("audio", "container"),
    "mediainfo": ("audio", "container"),
    "jpeg": ("images", "jpeg"),
    "png": ("images", "png"),
    "gif": ("images", "gif"),
    "tiff": ("images", "tiff"),
    "raw": ("images", "raw"),
    "webp": ("images", "webp"),
    "bmp": ("images", "bmp"),
    "icon": ("images", "icon"),
}


def module(name: str) -> Callable[[bytes, Info], Resource]:
    """The function of a module; one unknown or empty gives an empty resource."""
    if name not in MODULES:
        return lambda content, info: Resource()
    file, function = MODULES[name]
    return getattr(importlib.import_module(f"kartei.extract.{file}"), function)


class _Deadline:
    """Raises in the running row after some seconds; only where signals can be used."""

    def __init__(self, seconds: float):
        self.seconds = seconds
        self.usable = threading.current_thread() is threading.main_thread()

    def __enter__(self) -> None:
        if self.usable:
            self.old = signal.signal(signal.SIGALRM, self._raise)
            signal.setitimer(signal.ITIMER_REAL, self.seconds)

    def __exit__(self, *exc: object) -> None:
        if self.usable:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, self.old)

    @staticmethod
    def _raise(*args: object) -> None:
        raise TimeoutError("the deadline of the row passed")


def extract_one(content: bytes | None, url: str, mime: str | None, name: str | None, types: list[str], max_text: int = MAX_TEXT, deadline: float = DEADLINE, registry: Callable | None = None) -> tuple:
    """One output row."""
    try:
        with _Deadline(deadline):
            r = (registry or module)(name or "")(bytes(content or b""), Info(url, mime or "", max_text))
    except Exception as e:  # any failure of a module is data
        return url, mime, name, list(types), None, None, None, None, f"{type(e).__name__}: {e}"[:500]
    text = r.get("nie:plainTextContent")
    props = {k: v for k, v in r.props.items() if k not in ("nie:title", "nie:plainTextContent")}
    kids = [(hashlib.sha256(f"{url}\n{kind}\n{n}".encode()).hexdigest(), kind, n, p) for kind, n, p in r.children]
    return url, mime, name, list(r.types or types), r.get("nie:title"), limit_text(text, max_text) if text else None, props, kids, None


def extract(files: DataFrame, max_text: int = MAX_TEXT, deadline: float = DEADLINE, keep: tuple[str, ...] = (), at_once: int = 0) -> DataFrame:
    """files(url, mime_type, module, rdf_types, content) to the rows of SCHEMA; rows with an error have no metadata.

    Columns to ``keep`` go through unchanged, so nothing need be joined back. at_once: rows of a result batch, all of an
    Arrow batch for 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (b.iloc[k : k + (at_once or max(1, len(b)))] for b in batches for k in range(0, len(b), at_once or max(1, len(b)))):
            rows = [extract_one(r.content, r.url, r.mime_type, r.module, [] if r.rdf_types is None else list(r.rdf_types), max_text, deadline) for r in b.itertuples()]
            out = pd.DataFrame(rows, columns=["url", "mime_type", "module", "rdf_types", "title", "plain_text", "props", "children", "error"])
            for c in keep:
                out[c] = b[c].to_numpy()
            yield out

    kept = "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select("url", "mime_type", "module", "rdf_types", "content", *keep).mapInPandas(run, SCHEMA + kept)


def statistics(extracted: DataFrame) -> DataFrame:
    """(module, files, failed, share): what each module has read and failed on, and its share of all files in percent."""
    per = extracted.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return per.withColumn("share", F.round(100.0 * F.col("files") / F.sum("files").over(Window.partitionBy()), 6))  # one row a module


def errors(extracted: DataFrame) -> DataFrame:
    """The error reports: keyed by the MD5 of the url."""
    return extracted.where("error is not null").select(F.md5("url").alias("uri_md5"), F.col("url").alias("uri"), F.col("error").alias("message"))
