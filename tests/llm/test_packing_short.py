"""Many groups of short texts, of which one sequence holds more pieces than a twentieth of a group."""

import pytest

from locusflow.llm.packing import pack_documents


@pytest.mark.parametrize("text,docs,capacity,group", [("", 1500, 64, 100), ("a b c d", 1000, 512, 130), ("", 201, 2048, 100)])
def test_short_texts_reach_the_lower_bound(frame, text, docs, capacity, group):
    got = pack_documents(frame([(k, text) for k in range(docs)]), capacity=capacity, group_pieces=group).select("doc_id", "sequence_id", "length").collect()
    length = got[0].length
    fills = {}
    for r in got:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert len(got) == len({r.doc_id for r in got}) == docs and max(fills.values()) <= capacity
    assert len(fills) == -(-docs // (capacity // length))
