"""Merkle manifest against its SQL twin, a plain tree and hand-made cases."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from sparkbars.llm import merkle
from sparkbars.llm.queries import ORACLES, op12_merkle_manifest
from tests.llm.helpers import DOCUMENTS, folder, result, twin

NAME = "op12_merkle_manifest"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_root(nodes):
    while len(nodes) > 1:
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0]


def documents(rng, n):
    rows = [(None, "no id", "en", "s", 3), (None, None, None, None, None), (7, None, "de", None, None), (8, "", None, "", 0)]
    rows += [(i, f"text é {rng.random()}", rng.choice(["en", "en", "en", "de", "fr", None]), "s", rng.choice([i, None])) for i in range(n)]
    rows += [(5000, "x" * 2_000_000, "zz", "s", 2**63 - 1)]
    return rows + rows[-9:]


@pytest.mark.parametrize("levels", [10, 2, 1])
def test_random_tables_match_sql_whatever_the_blocks(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 2**levels)
    path = folder(tmp_path, documents=(DOCUMENTS, documents(random.Random(levels), 90)))
    got = result(op12_merkle_manifest(spark, path))
    assert got == twin(ORACLES[NAME], path, "documents")


def test_tampered_leaves_alone_fail(spark, tmp_path):
    rows = [(i, f"t{i}", "en", "s", i if i % 5 else None) for i in range(100)]
    got = {r["doc_id"]: r for r in op12_merkle_manifest(spark, folder(tmp_path, documents=(DOCUMENTS, rows))).collect()}
    bad = {i for i, r in got.items() if not r["verified"]}
    assert bad == {i for i in range(100) if crc32(str(i).encode()) % 7 == 0 and i % 5}
    want = plain_root([got[i]["leaf"] for i in range(100)])
    assert {r["subroot"] for r in got.values()} == {want} == {r["root"] for r in got.values()}


def test_versions_share_untouched_nodes():
    leaves = [h(str(i)).encode() for i in range(13)]
    pool = merkle.Pool(leaves, True)
    before, first = list(pool.hashes), pool.root.decode()
    for place in (0, 6, 12):
        size = len(pool.hashes)
        version = pool.version(place, h("new").encode())
        changed = [x.decode() for x in leaves]
        changed[place] = h("new")
        assert pool.hashes[version[-1]].decode() == plain_root(changed)
        # a version adds its path and nothing else, and every other child is a node of the first version
        assert len(pool.hashes) - size == len(version) == len(pool.levels)
        assert all(c in version or c < len(before) for v in version for c in pool.children[v])
    assert pool.hashes[: len(before)] == before and pool.root.decode() == first


def test_copied_nodes_and_audit_path_of_a_version(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(i, "ab"[i % 2], h(str(i)), h(f"new{i}") if i == 21 else None, "x", "y") for i in range(37)]
    made = merkle.manifest(spark.createDataFrame(rows, "doc_id long, lang string, leaf string, changed string, place string, key string"))
    got = {r["doc_id"]: r for r in made.collect()}
    groups = [[h(str(i)) for i in range(k, 37, 2)] for k in (0, 1)]
    assert got[0]["root"] == h(*map(plain_root, groups)) and got[36]["subroot"] == plain_root(groups[0])
    changed = [[h(f"new{i}") if i == 21 else h(str(i)) for i in range(k, 37, 2)] for k in (0, 1)]
    assert got[21]["copied"][0] == h("new21") and got[21]["copied"][-1] == got[21]["folded_root"] == h(*map(plain_root, changed))
    assert len(got[21]["copied"]) == 1 + 5 + 1 and all(got[i]["copied"] is None for i in got if i != 21)
    assert merkle.climb(h("3").encode(), bytes(got[3]["siblings"]))[-1].decode() == got[3]["root"]


def test_one_row_and_empty_table(spark, tmp_path):
    path = folder(tmp_path, documents=(DOCUMENTS, [(1, "a", "en", "s", 1)]))
    row = op12_merkle_manifest(spark, path).first()
    leaf = h("1:1", "1:s", "2:en", "1:1", "1:a")
    assert row["leaf"] == row["subroot"] == row["root"] == leaf and row["proof_sha256"] == h("")
    folder(tmp_path, documents=(DOCUMENTS, []))
    assert result(op12_merkle_manifest(spark, path)) == []
