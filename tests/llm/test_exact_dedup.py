import hashlib
from collections import defaultdict

import pytest
from kerbside.llm.exact_dedup import exact_duplicates


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_against_brute_force(odd_docs, block):
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[r.text or ""].append(r.doc_id)
    got = defaultdict(list)
    for r in exact_duplicates(odd_docs.where("length(text) < 3000 or text is null") if block == 3 else odd_docs, block).collect():
        got[r.text_sha256].append(r)
    for text, ids in groups.items():
        rows = got.pop(hashlib.sha256(text.encode()).hexdigest(), [])
        if block == 3 and len(text) >= 3000:
            continue
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
        top = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in rows} == {(top, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [top]
    assert not got


def test_nothing(no_docs):
    assert exact_duplicates(no_docs).count() == 0
