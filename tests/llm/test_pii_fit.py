"""The trees of op10 learn from all documents."""

import zlib

from replyloom.llm import op10_pii as op10


def test_rare_examples_outside_the_first_documents_count(spark, monkeypatch):
    order = sorted(range(4500), key=lambda d: (zlib.crc32(str(d).encode()), d))
    late = set(order[4000:])
    rows = [(d, f"write to u{d}@example.com" + (f" and see 12 345 {d % 90 + 10} {d + 1000} in the list" if d in late else "")) for d in range(4500)]
    fits, real = [], op10.fit
    monkeypatch.setattr(op10, "fit", lambda given: fits.append(real(given)) or fits[-1])
    done = op10.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert done.count() == len(rows) and done.filter("n_email <> 1").isEmpty()
    assert fits[0] is not None  # the only wrong proposals are in late documents
