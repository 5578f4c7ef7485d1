"""The functions under SQL names, and two table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="position int, command string, arguments array<string>")
class ShellSegments:
    """The simple commands of a shell line, with quotes taken off."""

    def eval(self, line: str) -> Iterator[tuple]:
        for i, words in enumerate(split_shell(line or "")):
            yield i, words[0], words[1:]


@F.udtf(returnType="suffix string, depth int")
class PathSuffixes:
    """All trailing sub-paths, longest first."""

    def eval(self, path: str) -> Iterator[tuple]:
        parts = (path or "").split("/")
        for k in range(len(parts) if path else 0):
            yield "/".join(parts[k:]), len(parts) - k


def split_shell(line: str) -> list[list[str]]:
    """Words of each simple command; operators outside quotes end one, assignments and wrappers in front go."""
    out: list[list[str]] = [[]]
    word, quote, some = "", "", False
    chars = iter(line)
    for c in chars:
        if quote:
            if c == quote:
                quote = ""
            elif c == "\\" and quote == '"':
                word += next(chars, "")
            else:
                word += c
        elif c in "'\"":
            quote, some = c, True
        elif c == "\\":
            word, some = word + next(chars, ""), True
        elif c.isspace() or c in ";|&()<>":
            if word or some:
                out[-1].append(word)
            word, some = "", False
            if c in ";|&()\n" and out[-1]:
                out.append([])
        else:
            word += c
    if word or some:
        out[-1].append(word)
    found = []
    for words in out:
        while words and (("=" in words[0] and words[0].split("=")[0].isidentifier()) or words[0] in ("sudo", "env", "time", "nohup", "command")):
            words = words[1:]
        if words:
            found.append(words)
    return found


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    spark.udtf.register("shell_segments", ShellSegments)
    spark.udtf.register("path_suffixes", PathSuffixes)
