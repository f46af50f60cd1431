"""Predicates over commands, paths, URLs and bodies."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col

#: Media types that are binary whatever the body says.
BINARY_TYPES = ("image/", "audio/", "video/", "application/pdf", "application/zip", "application/gzip", "application/octet-stream", "application/x-tar", "application/x-bzip")

_TOKEN = re.compile(r"""(?<!\\)['"`]|;|\|\||&&|\||.""", re.S)


def split_chain(command: str) -> list[str]:
    """The parts of a command between ; | || && outside of quotes. A quote right after a backslash is an ordinary character."""
    parts, quote = [""], ""
    for m in _TOKEN.finditer(command):
        token = m[0]
        marks = token in ("'", '"', "`") and command[m.start() - 1 : m.start()] != "\\"
        if marks and quote in ("", token):
            quote = "" if quote else token
        if not quote and token in (";", "|", "||", "&&"):
            parts.append("")
        else:
            parts[-1] += token
    return [p for p in (x.strip(" \t") for x in parts) if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_chain_udf(commands: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else split_chain(c) for c in commands], dtype=object)


def command_glob(pattern: str) -> str:
    """Regular expression of Bash(glob): in a:b the arguments are optional, * is any text."""
    glob = pattern[5:-1] if pattern.startswith("Bash(") and pattern.endswith(")") else ""
    star = lambda x: ".*".join(map(re.escape, x.split("*")))
    command, colon, arguments = glob.partition(":")
    return rf"^{re.escape(command)}(?:[\t\n\f\r ]{star(arguments)})?\z" if colon else rf"^{star(glob)}\z"


def path_glob(glob: str) -> str:
    """Regular expression of a path: **/ is any folders, ** any text, * and ? stay within a name."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(t, re.escape(t)) for t in re.findall(r"\*\*/|\*\*|.", glob)) + r"\z"


def _first_match(x: Column, patterns: list[str], to_regex) -> Column:
    tests = [F.when(x.rlike(to_regex(p)), F.lit(p)) for p in patterns]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def command_decision(command: Column | str, policies: list[dict[str, list[str]]], deny_only: bool = False) -> Column:
    """struct<decision, pattern>. Any denied part of the chain denies; then the first policy that asks or allows the whole
    command decides; else ask (allow, if only denials count)."""
    command = col(command)
    denied = [p for policy in policies for p in policy.get("deny", [])]
    hits = F.filter(F.transform(split_chain_udf(command), lambda s: _first_match(s, denied, command_glob)), lambda h: h.isNotNull())
    made = lambda decision, pattern: F.struct(F.lit(decision).alias("decision"), pattern.cast("string").alias("pattern"))
    out = made("allow" if deny_only else "ask", F.lit(None))
    if not deny_only:
        for policy in reversed(policies):
            for decision in ("allow", "ask"):
                hit = _first_match(command, policy.get(decision, []), command_glob)
                out = F.when(hit.isNotNull(), made(decision, hit)).otherwise(out)
    return F.when(F.size(hits) > 0, made("deny", F.get(hits, F.lit(0)))).otherwise(out)


def path_denied(path: Column | str, globs: list[str]) -> Column:
    """The first glob that denies the path, or null; back slashes count as slashes."""
    return _first_match(F.replace(col(path), F.lit("\\"), F.lit("/")), globs, path_glob)


#: Calls of other languages that run a shell command, and the quotes that their string may have.
_Q2, _Q3 = "'\"", "'\"`"
SHELL_CALLS = {
    "python": ((r"os\.system\(\s*", _Q2, r"\s*\)"), (r"subprocess\.(?:run|call|Popen|check_output|check_call)\(\s*", _Q2, "")),
    "javascript": ((r"exec(?:Sync|File|FileSync)?\(\s*", _Q3, ""), (r"spawn(?:Sync)?\(\s*", _Q3, "")),
    "typescript": ((r"exec(?:Sync|File|FileSync)?\(\s*", _Q3, ""), (r"spawn(?:Sync)?\(\s*", _Q3, "")),
    "ruby": ((r"system\(\s*", _Q2, ""), ("", "`", "")),
    "go": ((r"exec\.Command\(\s*", _Q3, ""),),
    "php": ((r"shell_exec\(\s*", _Q3, ""), (r"(?:^|[^.])exec\(\s*", _Q3, ""), (r"(?:^|[^.])system\(\s*", _Q3, ""), (r"passthru\(\s*", _Q3, ""), (r"proc_open\(\s*", _Q3, "")),
    "rust": ((r"Command::new\(\s*", _Q3, ""),),
}


def shell_commands(code: Column | str, language: str) -> Column:
    """Commands that code in another language hands to a shell, by kind of call and quote."""
    code = col(code)
    found = [F.regexp_extract_all(code, F.lit(f"{before}{q}([^{q}]*?){q}{after}"), F.lit(1)) for before, quotes, after in SHELL_CALLS.get(language, ()) for q in quotes]
    if language == "python":
        lists = F.regexp_extract_all(code, F.lit(r"subprocess\.(?:run|call|Popen|check_output|check_call)\(\s*\[([^\]]+)\]"), F.lit(1))
        found.append(F.transform(lists, lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"""['"]([^'"]*?)['"]"""), F.lit(1)), " ")))
    return F.filter(F.concat(*found), lambda c: c != "") if found else F.array().cast("array<string>")


def host_of(url: Column | str) -> Column:
    return F.coalesce(F.try_parse_url(col(url), F.lit("HOST")), F.lit(""))


def platform_url(url: Column | str) -> Column:
    """struct<host, owner, repo, number, kind> of an issue or a change request, else null. Owner and repo on github.com only."""
    host = host_of(url)
    parts = F.split(F.btrim(F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit("")), F.lit("/")), "/")
    kinds = F.create_map(*[F.lit(x) for pair in (("issues", "issue"), ("pull", "pr"), ("pulls", "pr"), ("pull-requests", "pr"), ("merge_requests", "mr")) for x in pair])
    at = F.array_min(F.filter(F.transform(parts, lambda p, i: F.when(kinds[p].isNotNull() & (i < F.size(parts) - 1), i)), lambda i: i.isNotNull()))
    third = F.get(parts, F.lit(2))
    own = (host == "github.com") & (F.size(parts) >= 4) & third.isin("issues", "pull")
    made = lambda owner, repo, number, kind: F.struct(host.alias("host"), owner.alias("owner"), repo.alias("repo"), number.alias("number"), kind.alias("kind"))
    return F.when(own, made(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), kinds[third])).when((host != "") & at.isNotNull(), made(F.lit(""), F.lit(""), F.get(parts, at + 1), kinds[F.get(parts, at)]))


def cli_hint(info: Column) -> Column:
    verb = F.when(info["kind"] == "issue", "gh issue view ").when(info["kind"] == "pr", "gh pr view ")
    return F.when((info["host"] == "github.com") & (info["owner"] != ""), F.concat(verb, info["number"], F.lit(" --repo "), info["owner"], F.lit("/"), info["repo"])).otherwise("")


def is_gist(url: Column | str) -> Column:
    return host_of(url).isin("gist.github.com", "gist.githubusercontent.com")


def private_host(host: Column | str) -> Column:
    """Loopback, private and link-local literals, of IPv4 and IPv6. Names aren't looked up, but localhost is one."""
    h = F.lower(F.btrim(col(host), F.lit("[]")))
    v4 = r"^(?:127|10)(?:\.\d{1,3}){3}$|^192\.168(?:\.\d{1,3}){2}$|^172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}$|^169\.254(?:\.\d{1,3}){2}$|^224\.0\.0\.\d{1,3}$"
    return (h == "localhost") | h.rlike(v4) | h.rlike(r"^::1$|^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:|^ff[0-9a-f]2:")


def is_binary(media_type: Column, body: Column) -> Column:
    """By media type; text/* is text; of others a NUL among the first 512 bytes tells."""
    kind = F.trim(F.substring_index(F.lower(F.coalesce(media_type, F.lit(""))), ";", 1))
    known = reduce(lambda a, b: a | b, [F.startswith(kind, F.lit(t)) for t in BINARY_TYPES])
    nul = F.hex(F.substring(body.cast("binary"), 1, 512)).rlike("^(?:..)*?00")
    return known | (~F.startswith(kind, F.lit("text/")) & nul)


def fetches_web(command: Column | str) -> Column:
    """Commands that fetch from the web to the terminal, or code with an HTTP call."""
    c = col(command)
    fetch = c.rlike(r"(?:^|[;&|\s])(?:curl|wget)\s")
    quiet = c.rlike(r"\s(?:-o|--output|-O|--remote-name|--output-document)(?:[\s=]|$)|>\s*\S")
    inline = c.rlike(r"""fetch\(\s*['"`]https?://|requests\.(?:get|post|put)\(|http\.(?:get|request)\(|urllib\.request""")
    return (fetch & ~quiet) | inline
