from lattica.llm import linededup


def expected(rows, size=3):
    order = sorted({(r[0] is not None, r[0] or 0) for r in rows})
    first, own = {}, {}
    for i, t in rows:
        own.setdefault((i is not None, i or 0), []).append((t or "").split("\n"))
    for key in order:
        places = {(at, tuple(lines[at : at + size])) for lines in own[key] for at in range(len(lines) - size + 1)}
        for at, w in sorted(places):
            first.setdefault(w, (key, at))
    out = []
    for i, t in rows:
        key, gone = (i is not None, i or 0), set()
        for lines in own[key]:
            for at in range(len(lines) - size + 1):
                k, a = first[tuple(lines[at : at + size])]
                if (k, a) != (key, at):
                    gone |= set(range(max(at, a + size) if k == key else at, at + size))
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if k not in gone]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(str, out))


def read(df):
    return sorted(str((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in df.collect())


def test_real_and_odd(real_docs, odd_docs, no_docs):
    for docs in (real_docs, odd_docs):
        assert read(linededup.dedup_lines(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert linededup.dedup_lines(no_docs).count() == 0


def test_overlaps(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd"), (4, "q\nq\nq\nq\nq"), (5, "a\nb"), (6, "q\nq\nq\nz"), (7, "\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert read(linededup.dedup_lines(docs)) == expected(rows)
    assert read(linededup.dedup_lines(docs, 2)) == expected(rows, 2)
