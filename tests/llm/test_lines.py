from collections import Counter

import regex

from sqltally.llm import line_dedup


def by_hand(rows):
    """(doc_id, text) to (doc_id, text, n_lines, n_removed); ids order the corpus, nulls first."""
    order = lambda place: (place[0] is not None, place[0] or 0, place[1])
    has_word = lambda line: regex.search(r"[^ \t-\r]", line)
    first, marked = {}, {}
    cut = [(i, [(k, x) for k, x in enumerate((t or "").split("\n")) if has_word(x)]) for i, t in rows]
    for i, lines in cut:
        for n in range(len(lines) - 2):
            window = tuple(x for _, x in lines[n : n + 3])
            first[window] = min(first.get(window, (i, n)), (i, n), key=order)
    for i, lines in cut:
        for n in range(len(lines) - 2):
            if first[tuple(x for _, x in lines[n : n + 3])] != (i, n):
                marked.setdefault(i, set()).update((n, n + 1, n + 2))
    out = []
    for (i, t), (_, lines) in zip(rows, cut):
        gone = {lines[n][0] for n in marked.get(i, ()) if n < len(lines)}
        text = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out.append((i, text, len(lines), len(gone)))
    return Counter(out)


def test_odd_rows(odd_docs, odd_rows):
    found = line_dedup.deduplicated(odd_docs)
    assert found.columns == [*odd_docs.columns, "n_lines", "n_removed"]
    assert Counter(map(tuple, found.select("doc_id", "text", "n_lines", "n_removed").collect())) == by_hand([r[:2] for r in odd_rows])
    assert line_dedup.deduplicated(odd_docs.limit(0)).count() == 0


def test_overlapping_windows_and_repeats_inside_a_document(spark):
    rows = [
        (1, "a\nb\nc\nd\ne"),
        (2, "x\nb\nc\nd\ne\ny"),
        (3, "a\n\nb\n \nc\nz"),
        (4, "q\nq\nq\nq\nq\nq"),
        (5, "b\nc"),
        (6, "\n".join(f"l{i % 500}" for i in range(5000))),
    ]
    found = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(map(tuple, found.collect())) == by_hand(rows)
