"""Columns of the caller that share a name with inner ones."""

from seriesloom.llm import sentencepiece_scan


def test_a_column_called_row_stays(docs):
    frame = docs([(1, "short text"), (2, "a longer text of several chunks " * 4), (3, None)], "row")
    out = sentencepiece_scan.encode(frame, chunk=40)
    assert sorted(out.columns) == ["doc_id", "ids", "row", "text"]
    back = sentencepiece_scan.decode(out).collect()
    assert sorted((r.doc_id, r.row, r.decoded) for r in back if r.text) == [(1, "x", "short text"), (2, "x", "a longer text of several chunks " * 4)]
    assert len(back) == 3
