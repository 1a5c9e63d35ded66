"""Files as documents: scans, filters, decoding, and what couldn't be read."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lexer import Lexer, strip_bom
from tessera.operators.mirror import MAX_FILE_LENGTH


@dataclass
class Config:
    """Settings of an index, as a configuration file has them."""

    file_name_regex: str | None = None
    index_directory: str = "index"
    directories: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    max_file_length: int = MAX_FILE_LENGTH
    max_read_attempts: int = 3
    additional_word_chars: str = ""
    max_word_length: int = 256
    case_sensitive: bool = False

    @classmethod
    def from_xml(cls, text: str) -> Config:
        """From child elements named as in FileNameRegex, Directory, File, MaxFileLength; lists repeat their element."""
        got = {}
        for e in ET.fromstring(text).iter():
            name, value = e.tag.rpartition("}")[2].lower(), (e.text or "").strip()
            if value:
                got.setdefault(name, []).append(value)
        one = lambda name, kind, default: kind(got[name][-1]) if name in got else default
        return cls(
            one("filenameregex", str, None), one("indexdirectory", str, "index"), got.get("directory", []), got.get("file", []),
            one("maxfilelength", int, MAX_FILE_LENGTH), one("maxreadattempts", int, 3), one("additionalwordchars", str, ""),
            one("maxwordlength", int, 256), one("casesensitive", lambda v: v.lower() == "true", False),
        )

    def lexer(self) -> Lexer:
        return Lexer(self.additional_word_chars, self.case_sensitive, self.max_word_length)


def listing(spark: SparkSession, paths: list[str], pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """path, length, mtime of the files below paths; contents aren't read. pattern: what a full name must contain, any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("ignoreMissingFiles", True).load(paths)
    found = found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", F.col("modificationTime").alias("mtime"))
    return found.where(F.col("path").rlike(f"(?i){pattern}")) if pattern else found


def below(path: Column, directory: str) -> Column:
    directory = directory.rstrip("/").upper()
    return (F.upper(path) == directory) | F.startswith(F.upper(path), F.lit(directory + "/"))


def read_texts(
    spark: SparkSession, paths: list[str], pattern: str | None = None, charset: str | Column = "UTF-8", max_length: int = MAX_FILE_LENGTH, exclude: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, too long, failed): (path, length, mtime, content), (path, length), (path, error).

    The bound on the length is pushed to the scan, so that longer files aren't read; they belong out of an index. Files
    below exclude, such as the index itself, are left out. A byte order mark decides the charset where there is one.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(paths)
    clean = F.regexp_replace("path", "^file:/*", "/")
    if pattern:
        raw = raw.where(clean.rlike(f"(?i){pattern}"))
    if exclude:
        raw = raw.where(~below(clean, exclude))
    name = charset if isinstance(charset, Column) else F.lit(charset)

    @F.pandas_udf("struct<content:string,error:string>")
    def decoded(data: pd.Series, charset: pd.Series) -> pd.DataFrame:
        marks = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
        out = []
        for x, name in zip(data, charset, strict=True):
            mark, name = next(((m, n) for m, n in marks if x.startswith(m)), (b"", name))
            try:
                out.append((bytes(x)[len(mark) :].decode(name, "replace"), None))
            except (LookupError, UnicodeError) as problem:
                out.append((None, str(problem)))
        return pd.DataFrame(out, columns=["content", "error"])

    fit = raw.where(F.col("length") < max_length)
    read = fit.select(clean.alias("path"), "length", F.col("modificationTime").alias("mtime"), decoded("content", name).alias("d"))
    texts = read.where("d.error is null").select("path", "length", "mtime", strip_bom(F.col("d.content")).alias("content"))
    failed = read.where("d.error is not null").select("path", F.col("d.error").alias("error"))
    long = raw.where(F.col("length") >= max_length).select(clean.alias("path"), "length")
    return texts, long, failed


def retried(action, attempts: int = 3):
    """action()'s result; it is tried again while it raises, attempts times in all."""
    for k in range(attempts):
        try:
            return action()
        except Exception:
            if k + 1 == attempts:
                raise
