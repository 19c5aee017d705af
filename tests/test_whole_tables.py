"""Queries keep the rows that their SQL does not know."""

import hashlib
import random
import re

import pyarrow.parquet
import pytest

from quarry.catalogue import QUERIES
from quarry.operators.chunking import SPACES


def brute_raw_text(text, target=2400, overlap=200):
    parts, whole = [p.strip(SPACES) for p in re.split("\n\n+", text or "") if p.strip(SPACES)], []
    for p in parts:
        if whole and len(whole[-1]) + 2 + len(p) <= target:
            whole[-1] += "\n\n" + p
        else:
            whole.append(p)
    out = whole[:1]
    for before, t in zip(whole, whole[1:]):
        end = before[-overlap:]
        out.append((("\n" + end.rpartition("\n")[2] if "\n" in end else end) + "\n\n" + t).strip(SPACES))
    return out


def test_chunk_raw_text_keeps_documents_with_blank_lines(spark, tmp_path):
    long = "\n\n".join(f"paragraph {i}\n" + f"w{i} " * (i * 37 % 300) for i in range(40))
    docs = [(1, "one paragraph\nof two lines"), (2, "a\n\nb\n\n\nc"), (3, long), (4, "\n\n \n\n"), (5, None), (6, "x\n\ny"), (6, "no blank line"), (7, "word " * 2000 + "\n\nend")]
    spark.createDataFrame([(i, t, "src0") for i, t in docs], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["chunk_raw_text"](spark, str(tmp_path)).collect()
    want = [(f"src0/{i}.py", n, hashlib.md5(c.encode()).hexdigest()) for i, t in docs for n, c in enumerate(brute_raw_text(t))]
    assert len(want) > 12
    assert sorted(map(tuple, got)) == sorted(want)


def joined(parts, target, separator):
    out = []
    for p in parts:
        if out and out[-1] and len(out[-1]) + len(separator) + len(p) <= target:
            out[-1] += separator + p
        elif out and not out[-1]:
            out[-1] = p
        else:
            out.append(p)
    return [t for t in out if t.strip(SPACES)]


def is_header(line):
    t = line.strip(SPACES)
    return 1 <= len(t) <= 100 and bool(re.search(r"^[A-Z][A-Z\s]{2,}[A-Z]$", t, re.A) or re.search(r"^(?:\d+\.(?:\d+\.)*\s+\S|Section\s+\d)", t, re.A | re.I))


def brute_document(text, target=2400, overlap=200):
    """Chunks (title, page, text) of a document whose pages end with form feeds."""
    pages, sections = text.split("\f"), []
    for number, page in enumerate(pages, 1):
        title, lines = None, []
        for line in [*page.strip(SPACES).split("\n"), None]:
            if line is None or is_header(line):
                body = "\n".join(lines).strip(SPACES)
                if body and page.strip(SPACES):
                    sections.append([title, number if len(pages) > 1 else None, body])
                title, lines = line and line.strip(SPACES), []
            else:
                lines.append(line)
    whole = []
    for title, number, body in sections:
        if whole and title is None and len(whole[-1][2]) + 2 + len(body) <= target:
            whole[-1][2] += "\n\n" + body
        else:
            whole.append([title or (whole[-1][0] if whole else None), number, body])
    small = []
    for title, number, body in whole:
        paragraphs = [body] if len(body) <= target else joined([p for p in re.split("\n\n+", body) if p.strip(SPACES)], target, "\n\n")
        for p in paragraphs:
            small += [(title, number, t) for t in ([p] if len(p) <= target else joined(re.split(r"\s+", p, flags=re.A), target, " "))]
    out = []
    for i, (title, number, t) in enumerate(small):
        if i:
            end = small[i - 1][2][-overlap:]
            t = ("\n" + end.rpartition("\n")[2] if "\n" in end else end) + "\n\n" + t
        out.append((title, number, re.sub("\n{3,}", "\n\n", t.replace("\f", "\n\n")).strip(SPACES)))
    return out


def opens(lines):
    """Whether a comment, a docstring or a template is open after each line."""
    state, out = None, []
    for line in lines:
        code = re.sub(r'"(?:\\.|[^"\\])*(?:"|$)|\'(?:\\.|[^\'\\])*(?:\'|$)|//.*', "", line)
        tick = len(re.findall(r"(?<!\\)`", code)) % 2 == 1
        docstring = line.count('"""') % 2 == 1 or line.count("'''") % 2 == 1
        if state == "comment":
            state = None if "*/" in code else state
        elif state == "template":
            state = None if tick else state
        elif "/*" in code and "*/" not in code:
            state = "comment"
        elif tick:
            state = "template"
        elif docstring:
            state = "comment"
        out.append(state is not None)
    return out


def brute_code(name, text, target=80, overlap=10):
    """Chunks (first line, last line, text) of a source file."""
    lines = text[:-1].split("\n") if text.endswith("\n") else text.split("\n")
    open_after = opens(lines)
    free = [i for i, line in enumerate(lines) if not line.strip(SPACES) and not open_after[i]]

    def ranges(points):
        taken = [0]
        for p in points:
            if p - taken[-1] >= target:
                taken.append(p)
        return list(zip(taken, [*(t - 1 for t in taken[1:]), len(lines) - 1]))

    double = [i for i in free if i and not lines[i - 1].strip(SPACES)]
    if len(lines) <= target:
        found = [(0, len(lines) - 1)]
    elif double and all(b - a + 1 <= 1.5 * target for a, b in ranges(double)):
        found = ranges(double)
    elif free:
        found = ranges(free)
    else:
        found = [(a, min(a + target, len(lines)) - 1) for a in range(0, len(lines), target)]
    out = []
    for i, (a, b) in enumerate(found):
        if i:
            a = min(a, max(found[i - 1][1] - overlap + 1, found[i - 1][0]))
        width = len(str(b + 1))
        out.append((a + 1, b + 1, f"// File: {name}\n" + "\n".join(f"{k + 1:>{width}} | {lines[k]}" for k in range(a, b + 1))))
    return out


def texts(seed):
    """Texts with all that the chunkers tell apart, at random."""
    dice = random.Random(seed)
    line = ["", "", "", " ", "INTRODUCTION PART", "1.2. Of words", "section 4", "NO", "a = 1  // it's", 's = "/*"', "/* begins", "ends */", "t = `open", "x`;", '"""', "'''", "plain words here ", "é 日本 " * 9, "\f", "w " * 1500, "x" * 2500]
    often = [20, 10, 5, 5, 3, 3, 2, 1, 9, 3, 2, 2, 2, 2, 2, 1, 30, 9, 2, 0.3, 0.3]
    return ["\n".join(dice.choices(line, often, k=dice.choice([1, 5, 30, 79, 81, 200, 500]))) + dice.choice(["", "\n", "\n\n"]) for _ in range(40)]


@pytest.fixture(scope="module")
def whole(sf, tmp_path_factory, spark):
    """All documents of the smallest tables, and texts at random."""
    given = pyarrow.parquet.read_table(f"{sf}/documents.parquet", columns=["doc_id", "source", "text"]).to_pylist()
    docs = [(r["doc_id"], r["source"], r["text"]) for r in given] + [(100_000 + i, "made", t) for i, t in enumerate([*texts(1), *texts(2), "", "\n", "\f\f", " \n\n ", None])]
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return folder, [(f"{source}/{i}.py", text) for i, source, text in docs if text is not None and text.strip(SPACES)]


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_chunk_document_against_brute_force(spark, whole):
    folder, docs = whole
    got = {(r.id, r.chunk_index): (r.title, r.start_line, r.end_line, r.content_md5) for r in QUERIES["chunk_document"](spark, folder).collect()}
    want = {(name, n): (title, page, page, md5(t)) for name, text in docs for n, (title, page, t) in enumerate(brute_document(text))}
    assert len(want) > len(docs) and got == want


def test_chunk_code_against_brute_force(spark, whole):
    folder, docs = whole
    got = {(r.id, r.chunk_index): (r.start_line, r.end_line, r.language, r.content_md5) for r in QUERIES["chunk_code"](spark, folder).collect()}
    want = {(name, n): (a, b, "python", md5(t)) for name, text in docs for n, (a, b, t) in enumerate(brute_code(name, text))}
    assert len(want) > len(docs) and got == want
