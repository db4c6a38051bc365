"""Edits whose neighbourhood decides a segment border further on."""
import numpy as np
import pytest

from stancekit.llm import counts
from stancekit.llm.encoder import encoder

ENC = encoder("byte_bpe_50k.json")


def edited(text, start, removed, inserted, chunks):
    parts = counts.segments(text, chunks) or [""]
    doc = counts.Document(ENC, text, counts.heap(np.array([len(p) for p in parts])), counts.heap(counts.count_tokens(ENC, parts)))
    counts.edit_all(ENC, [doc], [[{"start": start, "removed": removed, "inserted": inserted}]])
    assert doc.text == text[:start] + inserted + text[start + removed:]
    return doc


def test_newline_before_a_lone_newline():
    assert edited("abx\nDef", 3, 0, "\n", 1).total == counts.brute_count("abx\n\nDef")


@pytest.mark.parametrize("chunks", [1, 2, 16])
def test_newline_before_every_line_break(chunks):
    text = "".join(f"Line {i} of the text, it's here.\n{'Def' if i % 3 else '(a) b'} and more\n" for i in range(60))
    breaks = [i for i, ch in enumerate(text) if ch == "\n"]
    for at in breaks:
        for removed, inserted in ((0, "\n"), (0, " "), (1, ""), (0, "\n\n")):
            doc = edited(text, at, removed, inserted, chunks)
            assert doc.total == counts.brute_count(doc.text), (at, removed, inserted)
        doc = edited(text, at - 1, 1, "", chunks)
        assert doc.total == counts.brute_count(doc.text)
