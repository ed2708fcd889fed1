"""Which files a shell command reads, when it does nothing else."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# The commands that only print files, with their options. Single letters without a value; letters whose
# value is a count (n) or any text (t); long options likewise, with - for none, or the list of values they take.
_BAT = {
    "flags": "pnAPuf", "n": "", "t": "lrHm",
    "long": "plain:- number:- show-all:- unbuffered:- force-colorization:- style:t language:t line-range:t highlight-line:t map-syntax:t theme:t tabs:n "
    "wrap:auto,never,character color:auto,never,always decorations:auto,never,always italic-text:always,never terminal-width:t file-name:t paging:never",
}
READERS = {
    "cat": {"flags": "AbeEnstTuv", "n": "", "t": "", "long": "number:- number-nonblank:- show-all:- show-ends:- show-tabs:- show-nonprinting:- squeeze-blank:-"},
    "head": {"flags": "qv", "n": "nc", "t": "", "long": "lines:n bytes:n quiet:- silent:- verbose:-", "numeric": True},
    "tail": {"flags": "fFqvr", "n": "ncbs", "t": "", "long": "lines:n bytes:n follow:- retry:- quiet:- silent:- verbose:- pid:n sleep-interval:n max-unchanged-stats:n", "numeric": True},
    "nl": {
        "flags": "p", "n": "ilvw", "t": "bdfhns",
        "long": "body-numbering:t section-delimiter:t footer-numbering:t header-numbering:t line-increment:n join-blank-lines:n number-format:t number-separator:t starting-line-number:n number-width:n no-renumber:-",
    },
    "less": {
        "flags": "aBcCdeEFgGiIJKLmMnNqQrRsSuUwWX~", "n": "bhyz#", "t": "jpPx", "pager": True,
        "long": "chop-long-lines:- LINE-NUMBERS:- line-numbers:- RAW-CONTROL-CHARS:- raw-control-chars:- quit-if-one-screen:- quit-at-eof:- QUIT-AT-EOF:- no-init:- ignore-case:- IGNORE-CASE:- squeeze-blank-lines:- no-lessopen:- tabs:t pattern:t",
    },
    "more": {"flags": "dlfpcsu", "n": "n", "t": "", "long": "", "numeric": True, "pager": True},
    "bat": _BAT, "batcat": _BAT,
}
#: Before a JSON list of words that stands for a command.
WORDS = "\x00"
SHELLS = ("bash", "sh", "zsh", "dash")
_SED_LONG = ("--posix", "--debug", "--regexp-extended", "--null-data", "--unbuffered", "--separate")
_COUNT = re.compile(r"[+-]?\d+(?:\.\d+)?[A-Za-z]{0,3}")
_ADDRESS = r"(?:\d+|\$|/(?:[^/\\]|\\.)*/)"
_PRINT = re.compile(rf"(?:{_ADDRESS}(?:\s*,\s*(?:{_ADDRESS}|\+\d+|~\d+))?|\d+~\d+)?\s*p")
_RANGE = re.compile(r"\s*(\d+)\s*(?:,\s*(\d+)\s*)?p\s*")
_LEXEMES = re.compile(
    r"""(?P<gap>[ \t]+)|(?P<then>[;\n]|&&)|(?P<pipe>\|(?![|&]))|'(?P<single>[^']*)'|"(?P<double>(?:[^"\\$`]|\\(?s:.))*)"|(?P<join>\\\n)|\\(?P<escaped>.)|(?P<stderr>>\s*(?:/dev/null|&1)(?=$|[\s;|&]))|(?P<mark>[#~])|(?P<plain>[^\s;&|'"\\<>$`(){}!\#~]|[\r\f\v])"""
)


class Unknown(Exception):
    """The command's meaning depends on evaluation, or it does more than read."""


def words(command: str) -> Iterator[str | tuple[str, bool]]:
    """`|` and `;` as strings, words as (word, whether it is a pattern), with quoting applied.

    Expansions, substitutions, subshells, jobs, `||`, redirections but of discarded or merged errors, and unterminated
    quotes raise."""
    at, word, glob = 0, None, False
    while at < len(command):
        found = _LEXEMES.match(command, at)
        if not found:
            raise Unknown
        kind, value = found.lastgroup, found.group(found.lastgroup)
        at = found.end()
        if kind in ("gap", "then", "pipe"):
            if word is not None:
                yield word, glob
            word, glob = None, False
            if kind != "gap":
                yield "|" if kind == "pipe" else ";"
        elif kind == "stderr":
            if word != "2" or glob:
                raise Unknown
            word = None
        elif kind == "mark":
            if word is None:
                raise Unknown
            word += value
        elif kind != "join":
            if kind == "double":
                # The pattern lets no bare $ or ` in, and within quotes only these can be escaped.
                value = re.sub(r'\\(["\\$`])', r"\1", value.replace("\\\n", ""))
            glob = glob or (kind == "plain" and value in "*?[")
            word = (word or "") + value
    if word is not None:
        yield word, glob


def _pipelines(command: str | list[str]) -> list[list[list[tuple[str, bool]]]]:
    """Pipelines of commands of words; a list of words is one command. Commands of a shell's -c are taken out."""
    for _ in range(3):
        tokens = [(w, False) for w in command] if isinstance(command, list) else list(words(command))
        if not tokens or isinstance(tokens[0], str) or posixpath.basename(tokens[0][0]) not in SHELLS:
            break
        *options, last = tokens[1:] or [None]
        # Only option letters may come before the script, and the last of them says that it is one.
        plain = all(isinstance(t, tuple) and not t[1] and re.fullmatch("-[a-z]+", t[0]) for t in options)
        if not options or not plain or ["c" in t[0] for t in options] != [False] * (len(options) - 1) + [True] or not isinstance(last, tuple) or last[1]:
            raise Unknown
        command = last[0]
    else:
        raise Unknown
    out: list[list[list[tuple[str, bool]]]] = [[[]]]
    for token in tokens:
        if token == "|":
            if not out[-1][-1]:
                raise Unknown
            out[-1].append([])
        elif token == ";":
            if not out[-1][-1] and len(out[-1]) > 1:
                raise Unknown
            if out[-1][-1]:
                out.append([[]])
        else:
            out[-1][-1].append(token)
    if not out[-1][-1]:
        if len(out[-1]) > 1:
            raise Unknown
        out.pop()
    if not out:
        raise Unknown
    return out


class _Args:
    """The words after a command's name, taken one by one."""

    def __init__(self, args: list[tuple[str, bool]]) -> None:
        self.args, self.at = args, 0

    def __iter__(self) -> Iterator[tuple[str, bool]]:
        while self.at < len(self.args):
            self.at += 1
            yield self.args[self.at - 1]

    def rest(self) -> list[tuple[str, bool]]:
        self.at, at = len(self.args), self.at
        return self.args[at:]

    def value(self, inline: str | None) -> str:
        """An option's value: what is written to it, else the next word."""
        if inline is not None:
            return inline
        if self.at == len(self.args) or self.args[self.at][1]:
            raise Unknown
        self.at += 1
        return self.args[self.at - 1][0]


def _taken(kind: str, value: str) -> None:
    if not (kind == "t" or (kind == "n" and _COUNT.fullmatch(value)) or (kind not in "tn" and value in kind.split(","))):
        raise Unknown


def _operands(name: str, args: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """The file operands of a reader; anything not known to be a pure read raises."""
    if name == "sed":
        return _sed_operands(args)
    known = READERS.get(name)
    if known is None:
        raise Unknown
    long = dict(o.split(":") for o in known["long"].split())
    out: list[tuple[str, bool]] = []
    left = _Args(args)
    for word, glob in left:
        if word == "--":
            out += left.rest()
        elif known.get("pager") and word.startswith("+"):
            raise Unknown
        elif not word.startswith("-") or word == "-":
            out.append((word, glob))
        elif glob:
            raise Unknown
        elif known.get("numeric") and re.fullmatch(r"-\d+", word):
            continue
        elif word.startswith("--"):
            option, given, value = word[2:].partition("=")
            kind = long.get(option)
            if kind is None or (kind == "-" and given):
                raise Unknown
            if kind != "-":
                _taken(kind, left.value(value if given else None))
        else:
            for k, letter in enumerate(word[1:], 2):
                kind = "n" if letter in known["n"] else "t" if letter in known["t"] else None
                if kind:
                    _taken(kind, left.value(word[k:] or None))
                    break
                if letter not in known["flags"]:
                    raise Unknown
    return out


def _sed_operands(args: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """Of `sed -n` with nothing but print commands."""
    scripts, out, quiet = [], [], False
    left = _Args(args)
    for word, glob in left:
        if word == "--":
            out += left.rest()
        elif not word.startswith("-") or word == "-":
            out.append((word, glob))
        elif glob:
            raise Unknown
        elif word == "--expression" or word.startswith("--expression="):
            scripts.append(left.value(word.partition("=")[2] if "=" in word else None))
        elif word in ("--quiet", "--silent"):
            quiet = True
        elif word.startswith("--"):
            if word not in _SED_LONG:
                raise Unknown
        else:
            flags, e, script = word[1:].partition("e")
            if any(f not in "nErsuz" for f in flags):
                raise Unknown
            quiet = quiet or "n" in flags
            if e:
                scripts.append(left.value(script or None))
    if not scripts:
        if not out or out[0][1]:
            raise Unknown
        scripts.append(out.pop(0)[0])
    commands = [[c.strip() for c in re.split(r"[;\n]", s) if c.strip()] for s in scripts]
    if not quiet or not all(c and all(map(_PRINT.fullmatch, c)) for c in commands):
        raise Unknown
    return out


def _within(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def _resolved(base: str, path: str) -> str:
    return "/" + posixpath.normpath(posixpath.join(base, path)).lstrip("/")


def _paths(command: str | list[str], cwd: str, root: str) -> list[str]:
    """The files that a pure read reads, all below root; patterns are reads without a path."""
    out: dict[str, None] = {}
    base, reads = cwd, False
    for pipeline in _pipelines(command):
        for place, (name, *args) in enumerate(pipeline):
            if name[1]:
                raise Unknown
            if name[0] in ("cd", "echo"):
                if len(pipeline) > 1 or any(g for _, g in args) or (name[0] == "cd" and len(args) != 1):
                    raise Unknown
                if name[0] == "cd":
                    base = _resolved(base, args[0][0])
                continue
            found = [(w, g) for w, g in _operands(name[0], args) if g or w != "-"]
            if not found and place == 0:
                raise Unknown
            reads = reads or bool(found)
            if not all(_within(_resolved(base, w), root) for w, _ in found):
                raise Unknown
            out |= dict.fromkeys(_resolved(base, w) for w, g in found if not g)
    if not reads:
        raise Unknown
    return list(out)


def _range(args: list[str], operands: int) -> tuple[int, int] | None:
    """The lines that `sed -n 'a,bp'` or `head -n N` prints, with so many operands after it."""
    name, options = args[0], args[1 : len(args) - operands]
    if name == "sed":
        found = _RANGE.fullmatch(options[1]) if len(options) == 2 and options[0] == "-n" else None
        low, high = (int(found[1]), int(found[2] or found[1])) if found else (0, 0)
    elif name == "head":
        found = re.fullmatch(r"-n (\d+)|-n?(\d+)", " ".join(options))
        low, high = 1, int(found[1] or found[2]) if found else 0
    else:
        return None
    return (low, high) if 1 <= low <= high else None


def _printed(command: str | list[str], cwd: str, root: str) -> tuple[str, str, int | None, int | None] | None:
    """(path, format, first, last line) of the one file that a command prints in order, as it is or numbered."""
    base, read = cwd, None
    for pipeline in _pipelines(command):
        if len(pipeline) > 2 or any(g for command in pipeline for _, g in command):
            return None
        head, *filters = [[w for w, _ in command] for command in pipeline]
        if head[0] == "cd" and len(head) == 2 and not filters:
            base = _resolved(base, head[1])
            continue
        if read is not None or len(head) < 2 or head[-1] == "-":
            return None
        shape = " ".join(head[:-1])
        lines = _range(head, 1)
        if shape not in ("cat", "cat -n", "nl -ba", "nl -b a") and lines is None:
            return None
        if filters:
            if lines is not None or (lines := _range(filters[0], 0)) is None:
                return None
        path = _resolved(base, head[-1])
        if not _within(path, root):
            return None
        read = (path, "plain" if shape == "cat" or head[0] in ("sed", "head") else "numbered", *(lines or (None, None)))
    return read


def file_reads(command: str | list[str] | None, cwd: str | None, root: str | None = None) -> tuple[list[str], str, tuple | None]:
    """(paths, kind, read) of a command run in cwd: artifact_access where it only prints files below root (by default
    cwd), else other."""
    if command is None or not cwd:
        return [], "other", None
    try:
        return _paths(command, cwd, root or cwd), "artifact_access", _printed(command, cwd, root or cwd)
    except Unknown:
        return [], "other", None


READ = "struct<path: string, format: string, first: long, last: long>"


def shell_reads(calls: DataFrame, command: str = "command", cwd: str = "cwd", root: str | None = None) -> DataFrame:
    """Adds paths, tool_kind and read to calls (command: a string, an array of words, or WORDS and such an array as JSON;
    cwd: where it runs, root: the folder below which files are read, by default cwd).

    Each distinct command and folder is parsed once and joined back, however many calls repeat it. Null commands and
    null folders are `other` and are not parsed."""
    names = {"command_": command, "cwd_": cwd, "root_": root or cwd}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            argv = [list(c) if not isinstance(c, str) else json.loads(c[1:]) if c.startswith(WORDS) else c for c in rows["command_"]]
            found = [file_reads(c, d, r) for c, d, r in zip(argv, rows["cwd_"], rows["root_"], strict=True)]
            read = [dict(zip(("path", "format", "first", "last"), r, strict=True)) if r else None for _, _, r in found]
            yield pd.DataFrame({**{c: rows[c] for c in names}, "paths": [p for p, _, _ in found], "tool_kind": [k for _, k, _ in found], "read": read})

    kind = calls.schema[command].dataType.simpleString()
    once = calls.select(*(F.col(c).alias(n) for n, c in names.items())).dropna().distinct()
    known = once.mapInPandas(parse, f"command_ {kind}, cwd_ string, root_ string, paths array<string>, tool_kind string, read {READ}")
    on = [F.col(c) == F.col(n) for n, c in names.items()]
    rows = calls.join(known, on, "left").drop(*names)
    return rows.withColumn("paths", F.coalesce("paths", F.array().cast("array<string>"))).withColumn("tool_kind", F.coalesce("tool_kind", F.lit("other")))
