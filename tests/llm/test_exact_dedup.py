import hashlib
from collections import Counter, defaultdict

import pytest

from quern.llm.exact_dedup import deduplicated, exact_dedup

from .helpers import SPACE, frame, rows


def brute(data):
    groups = defaultdict(list)
    for i, text, *_ in data:
        groups[SPACE.sub(" ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("salt_rows", [2, 20_000])
def test_against_brute_force(spark, salt_rows):
    data = rows() + [(100 + i, "hot  text" if i % 2 else "hot text", None, "s0", 8) for i in range(300)] + [(1000 + i, f"t{i % 40}", None, None, 1) for i in range(100)]
    found = exact_dedup(frame(spark, extra=True, data=data), salt_rows=salt_rows).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute(data)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    stays = deduplicated(frame(spark, extra=True, data=data), salt_rows=salt_rows)
    assert stays.columns == frame(spark, extra=True).columns
    texts = {i: t for i, t, *_ in data}
    own = stays.collect()
    assert Counter(r.doc_id for r in own) == Counter(r.doc_id for r in kept)
    assert all(r.text == texts[r.doc_id] or r.doc_id is None or SPACE.sub(" ", r.text or "") == SPACE.sub(" ", texts[r.doc_id] or "") for r in own)


def test_empty_table(spark):
    assert exact_dedup(frame(spark, empty=True)).count() == 0 == deduplicated(frame(spark, empty=True)).count()
