"""Mangled names against a probe of all ways to split them."""

import random

from lexspark.operators import folders


def probe(at: str, parts: list[str], known: set[str]) -> str | None:
    if not parts:
        return at
    for i in range(1, len(parts) + 1):
        names = ["-".join(parts[:i])] + ([".".join(parts[:i])] if i > 1 else ["." + parts[0]])
        for name in names:
            to = at if name in ("", ".") else at.rstrip("/") + "/" + name
            if to in known and (found := probe(to, parts[i:], known)):
                return found
    return None


def with_parents(paths) -> set[str]:
    return {"/"} | {"/".join(p.split("/")[:i]) for p in paths for i in range(2, p.count("/") + 2)}


def resolved(spark, names, known) -> dict[str, str]:
    rows = folders.unmangled(spark.createDataFrame([(n,) for n in names], "project_dir string"), spark.createDataFrame([(p,) for p in known], "path string")).collect()
    assert len(rows) == len(set(names))
    return {r.project_dir: r.path for r in rows}


def test_names_of_folders(spark):
    known = with_parents(["/home/u/my-app", "/home/u/my/app", "/home/u/my.app", "/home/u/.config", "/home/u/a.b-c", "/w/x-y.z", "/w/-x", "/w/a.b.c", "/only.dot"])
    names = ["-home-u-my-app", "-home-u--config", "-home-u-config", "-home-u-a-b-c", "-w-x-y-z", "-w--x", "-w-a-b-c", "-only-dot", "-", "--", "-home-u-", "home-u", "", "-gone"]
    got = resolved(spark, names, known)
    assert got["-home-u-my-app"] == "/home/u/my/app" and got["-home-u--config"] == got["-home-u-config"] == "/home/u/.config"
    assert got["-home-u-a-b-c"] is None and got["-w-x-y-z"] is None and got["home-u"] is None and got["-"] == "/"
    for name in names:
        assert got[name] == (probe("/", name[1:].split("-"), known) if name.startswith("-") else None), name


def test_against_all_splits(spark):
    rng = random.Random(7)
    paths = {"/" + "/".join("".join(rng.choice("ab.-") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))) for _ in range(400)}
    known = with_parents(p for p in paths if not any(s in (".", "..") or set(s) == {"."} for s in p.split("/")[1:]))
    names = {p.replace("/", "-").replace(".", "-") for p in known | paths} | {"-" + "".join(rng.choice("ab-") for _ in range(5)) for _ in range(200)}
    got = resolved(spark, names, known)
    assert got == {n: probe("/", n[1:].split("-"), known) for n in names}


def test_no_folders_and_nulls(spark):
    names = spark.createDataFrame([("-a",), (None,), ("-a",)], "project_dir string")
    none = spark.createDataFrame([], "path string")
    assert sorted(map(tuple, folders.unmangled(names, none).collect()), key=str) == [("-a", None), (None, None)]
