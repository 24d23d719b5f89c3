"""Manifests and their witnesses against building the whole tree."""

from __future__ import annotations

import hashlib

import pytest

from snapgrid.llm import merkle
from snapgrid.llm.common import session


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    out = []
    for nodes in tree[:-1]:
        if at ^ 1 < len(nodes):
            out.append(nodes[at ^ 1])
        at >>= 1
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof) of (doc_id, source, lang, n_chars, text)."""
    leaves = {}
    for row in rows:
        leaves.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, h(*map(field, row)), row[0]))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels([x[2] for x in sorted(leaves[lang], key=lambda x: x[:3])]) for lang in langs}
    top, out = levels([trees[lang][-1][0] for lang in langs]), []
    for place, lang in enumerate(langs):
        for at, x in enumerate(sorted(leaves[lang], key=lambda x: x[:3])):
            proof = [*siblings(trees[lang], at), *siblings(top, place)]
            out.append((x[3], x[2], trees[lang][-1][0], top[-1][0], h(*proof)))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 3, 12])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 11, 33])
def test_appended_blocks_are_the_tree(n, height):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    whole = levels([x.hex() for x in leaves])
    root, sides, proofs = merkle.append_all(leaves, None)
    assert root.hex() == whole[-1][0]
    for at in range(n):
        assert proofs[at].hex() == "".join(siblings(whole, at)) and merkle.folded(leaves[at], sides[at], proofs[at]) == root
    lifted = merkle.append_all(leaves[:3], 12)
    assert all(len(s) == 12 and merkle.folded(leaf, s, p) == lifted[0] for leaf, s, p in zip(leaves[:3], *lifted[1:]))


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.fixture
def rows():
    langs = ["en"] * 37 + ["fr"] * 8 + ["zh"] + ["é"] * 2 + [None] * 5 + [""] * 3
    out = [(n * 3, f"s{n % 4}", lang, n, f"text {n} é\n") for n, lang in enumerate(langs)]
    out += [(None, None, "en", None, None)] * 3 + [(6, "x", "en", 1, "again"), (6, "x", "en", 1, "again"), (6, "x", "en", None, ""),
                                                   (999, "s", "fr", 1, "long " * 50_000)]
    return out


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest_like_the_whole_tree(spark, rows, height):
    session(spark)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", hash string, pos int").repartition(5)
    found = merkle.manifest(docs, height=height)
    got = merkle.checked(found, found["leaf"]).collect()
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in got)
    assert sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got), key=str) == plain(rows)


def test_one_leaf_and_none(spark):
    lone = merkle.manifest(spark.createDataFrame([(1, "s", "en", 1, "t")], DOCS)).collect()
    assert [(r["leaf"], r["sides"], r["siblings"]) for r in lone] == [(lone[0]["root"], b"", b"")] and lone[0]["subroot"] == lone[0]["root"]
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], DOCS), height=0)


def test_a_changed_leaf_leads_elsewhere(spark, rows):
    found = merkle.manifest(spark.createDataFrame(rows, DOCS), height=2)
    got = merkle.checked(found, merkle.leaf_of(found["id"])).collect()
    assert not any(r["verified"] for r in got)
