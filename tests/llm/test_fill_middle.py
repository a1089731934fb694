import hashlib
import re

import numpy as np
import pytest

from isoflow.llm import fill_middle
from isoflow.llm.fill_middle import ARRAY, BITMAP, RUNS, BoundarySet, boundaries
from tests.llm.conftest import ODD, doc


@pytest.mark.parametrize("kind", [ARRAY, BITMAP, RUNS])
def test_every_container_selects_its_members(kind):
    rng = np.random.default_rng(1)
    places = {
        ARRAY: np.unique(rng.integers(0, 300_000, 3000)),
        BITMAP: np.unique(rng.integers(0, 300_000, 150_000)),
        RUNS: np.concatenate([np.arange(a, a + 900) for a in range(0, 300_000, 1000)]),
    }[kind]
    found = BoundarySet(places)
    assert {c.kind for c in found.containers} == {kind} and len(found) == len(places) and len(found.containers) == 5
    for k in [0, len(places) - 1, *rng.integers(0, len(places), 2000).tolist()]:
        assert found.select(k) == places[k]


def test_boundaries_are_those_of_the_pattern():
    for text in ["", "a", "ab cd", "  ", "été d'ABC\n1234x@[`{Z", "漢字🎉ab", "x" * 70_000 + " 1" * 40_000]:
        ends = [0, *(m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text))]
        found = boundaries(text)
        assert [found.select(k) for k in range(0, len(found), 1 + len(found) // 500)] == ends[:: 1 + len(found) // 500] and len(found) == len(ends)


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_against_brute_force(spark, odd_docs, no_docs):
    more = [doc(100 + i, t) for i, t in enumerate(["a<P>b", "<<S>", "<", "<S", "x<", "P>q<M", "\x00 nul", "line\nline\r\n", "ab" * 50_000 + " .." * 40_000] * 12)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    done = fill_middle.fill_in_middle(docs)
    got = done.withColumn("restored", fill_middle.restored(done["output"], done["form"])).collect()
    want = [brute(r[0], r[1]) for r in ODD + more]
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r)[:6] for r in got) == order(want)
    assert order((r.doc_id, r.restored) for r in got) == order((r[0], r[1] or "") for r in ODD + more)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(no_docs).count() == 0
