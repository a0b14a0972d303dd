import datetime as dt

from pyspark.sql import functions as F

from notegrid.functions import markdown as md
from notegrid.functions.text import est_tokens, fold, fold_letters, lexical_terms, norm_path, parse_date
from notegrid.operators import chunking, notes
from notegrid.sources.notes import load_index, publish_index, read_cases, read_notes, write_report

RAW = """---
titulo: Política de accesos
estado: Vigente
tags: [Seguridad, "Área TIC"]
fecha_vigencia: 2024-03-01
fecha_revision: 2024-12
---
# Título
Intro con #Etiqueta/Uno y [[Otra nota#Parte|alias]].

## Detalle ##
> [!danger]- Derogado
> texto

```python
# no es #tag [[ni enlace]]
```
| a | [[Tabla\\|t]] |
Linea final ^ancla-1
"""


def note(spark, raw=RAW, path="area/Nota Uno.md"):
    return notes.parsed_notes(spark.createDataFrame([(path, raw)], "path string, raw string"), dt.date(2025, 1, 1))


def test_note_columns(spark):
    r = note(spark).first()
    assert (r.title, r.status) == ("Política de accesos", "vigente")
    assert r.tags == ["seguridad", "area tic", "etiqueta/uno"]
    assert [(x.target, x.section, x.alias, x.embedded) for x in r.links] == [("Otra nota", "Parte", "alias", False), ("Tabla", "", "t", False)]
    assert [(c.kind, c.title, c.body) for c in r.callouts] == [("danger", "Derogado", "texto")]
    assert r.anchors == {"ancla-1": "Linea final"}
    assert r.validity == "caducada" and r.review_overdue and r.valid_from == dt.date(2024, 3, 1)


def test_note_without_frontmatter(spark):
    r = note(spark, "sin nada\n---\nx: 1\n---\n", "b/Mi nota.md").first()
    assert (r.title, r.status, r.metadata, r.validity) == ("Mi nota", "", {}, "desconocida")
    bad = note(spark, "---\nsin dos puntos\nlista:\n- uno\n- dos\n---\n# H\n").first()
    assert bad.metadata == {"_yaml_error": "true"} and bad.title == "H"
    assert note(spark, None).first().body == ""


def test_dates_and_text(spark):
    rows = [("2024-01-02", "2024-01-02"), ("02/01/2024", "2024-01-02"), ("2024-03", "2024-03-01"), ("2024", "2024-01-01"), ("2024-05-06T10:00:00", "2024-05-06"), ("x", None), ("2024-13-40", None)]
    df = spark.createDataFrame(rows, "d string, e string")
    assert all(str(r.p) == str(r.e) for r in df.select(parse_date(F.col("d")).alias("p"), "e").collect())
    t = spark.createDataFrame([("Ação  STRASSE ßÑ", "  A\\B/Ñ ", "¿Qué RELACIÓN hay entre _el_ proceso 7 y 7? x")], "a string, p string, q string")
    r = t.select(fold("a").alias("f"), fold_letters(F.col("a")).alias("l"), norm_path(F.col("p")).alias("p"), lexical_terms(F.col("q")).alias("q"), est_tokens(F.col("a")).alias("n")).first()
    assert r.f == r.l == "acao  strasse ssn" and r.p == "a/b/ñ" and r.q == ["relacion", "proceso", "7"] and r.n == 4


def test_chunks_keep_structure():
    code = "```sql\n" + "\n".join(f"select {i} from tabla_larga_{i};" for i in range(80)) + "\n```"
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| fila {i} | {'x' * 20} |" for i in range(60))
    body = f"Inicio.\n\n# Uno\n\n{code}\n\ntexto suelto\n\n## Dos\n\n{table}\n"
    for size in (150, 400, 900, 1200):
        chunks = md.note_chunks(body, size, 60)
        assert not any(md.odd_fences(c["content"]) for c in chunks)
        assert all(c["content"].startswith("| a | b |") or "fila" not in c["content"] or "| a | b |" in c["content"] for c in chunks)
        assert all("```sql" in c["content"] for c in chunks if "select" in c["content"])
    assert [c["heading"] for c in md.note_chunks("hola", 100, 0)] == ["Documento"]
    assert md.note_chunks("  \n", 100, 0) == []
    assert [h for h, _ in md.sections("a\n# B\nc\n# D\n")] == ["Introducción", "B"]


def test_parent_child(spark):
    body = "# A\n" + "\n\n".join(f"parrafo {i} " + "palabra " * 20 for i in range(30)) + "\n# B\ncorto\n"
    parents, children = chunking.chunk_parent_child(spark.createDataFrame([(1, body), (2, ""), (3, None)], "id long, body string"), "id", 1200, 300, 50)
    p, c = parents.orderBy("parent_index").collect(), children.orderBy("chunk_index").collect()
    assert [r.parent_index for r in p] == list(range(len(p))) and [r.chunk_index for r in c] == list(range(len(c)))
    assert {r.parent_index for r in c} == {r.parent_index for r in p} and {r.heading for r in p} == {"A", "B"}


def test_sources(spark, tmp_path):
    for path, data in {"a/Uno.md": b"\xef\xbb\xbfhola\r\nmundo\xff", "_plantillas/x.md": b"x", ".obsidian/y.md": b"y", "b/z.txt": b"z", "b/.oculto.md": b"q", "b/dos.md": b"2"}.items():
        f = tmp_path / "v" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    got = {r.path: r.raw for r in read_notes(spark, str(tmp_path / "v")).collect()}
    assert set(got) == {"a/Uno.md", "b/dos.md"} and got["a/Uno.md"].startswith("hola\nmundo")
    (tmp_path / "cases.json").write_text(
        '{"cases": [{"id": "1", "question": " q ", "expected_paths": ["A\\\\B.md"], "expected_terms": ["uno", ["dos", "tres"]]}, {"id": "2", "question": "x", "expect_abstention": true},'
        '{"id": "3", "question": "x"}, {"id": "2", "question": "y", "expect_abstention": true}, {"id": "4", "question": " "}, {"id": "5", "question": "z", "expected_paths": ["p"], "query_type": "raro"}]}'
    )
    good, bad = read_cases(spark, str(tmp_path / "cases.json"))
    assert [(r.id, r.question, r.expected_paths, r.expected_terms, r.query_type) for r in good.collect()] == [("1", "q", ["a/b.md"], [["uno"], ["dos", "tres"]], "factual")]
    assert {(r.id, r.reason) for r in bad.collect()} == {("2", "repeated id"), ("3", "answerable without expected paths"), ("4", "missing question"), ("5", "unknown query type")}
    one, two = spark.range(3), spark.range(5)
    publish_index(spark, {"chunks": one}, str(tmp_path / "ix"), "r1")
    try:
        publish_index(spark, {"chunks": two}, str(tmp_path / "ix"), "r2", {"chunks": 4})
        raise AssertionError("must fail")
    except ValueError:
        pass
    assert load_index(spark, str(tmp_path / "ix"), ["chunks"])["chunks"].count() == 3
    publish_index(spark, {"chunks": two}, str(tmp_path / "ix"), "r3")
    assert load_index(spark, str(tmp_path / "ix"), ["chunks"])["chunks"].count() == 5
    m = spark.createDataFrame([("s", 0.5, None)], "strategy string, recall double, mrr double")
    write_report(m, m, str(tmp_path / "rep"), "strategy", ["recall", "mrr"])
    assert [r.value for r in spark.read.text(str(tmp_path / "rep/table")).collect()][-1] == "| s | 50.0 % | N/A |"


def test_frontmatter_values(spark):
    raw = """---
# un comentario
titulo: "Urgencias, triaje: parte 1"
descripcion: Dosis 1,5 mg  # nota
frase: 'don''t # no'
etiquetas: uno, dos tres
tags:
  # otro
  - Alta urgencia
  - "b, c"
flow: [a, "b, c", 'd']  # fin
vacio:
nulo: ~
url: http://x.y/z#ancla
---


# Cuerpo
"""
    r = notes.parse_frontmatter(spark.createDataFrame([(raw,), (raw.replace("tags:", "otros:"),), ("---\nnada\n---\nx",)], "raw string")).collect()
    m = r[0].metadata
    assert m == {
        "titulo": "Urgencias, triaje: parte 1", "descripcion": "Dosis 1,5 mg", "frase": "don't # no", "etiquetas": "uno, dos tres", "tags": "Alta urgencia, b, c",
        "flow": "a, b, c, d", "vacio": "", "nulo": "", "url": "http://x.y/z#ancla",
    }
    assert r[0].lists == {"tags": ["Alta urgencia", "b, c"], "flow": ["a", "b, c", "d"]} and r[0].body == "# Cuerpo\n"
    assert r[2].metadata == {"_yaml_error": "true"} and r[2].body == "x"
    first, second = note(spark, raw).first(), note(spark, raw.replace("tags:", "otros:")).first()
    assert first.tags == ["alta urgencia", "b, c"] and second.tags == ["uno", "dos", "tres"] and first.title == "Urgencias, triaje: parte 1"


def test_code_hides(spark):
    body = "a ``[[x]] ` #y`` [[b\nc#d\\|e]] `[[z]]` ``#w\n````\n[[dentro]] #no\n~~~\n```\n#si [[A[1#s]] ![[ f ]] &#no a#no\n~~~ info\n#no\n"
    r = note(spark, body).first()
    assert [(x.target, x.section, x.alias, x.embedded) for x in r.links] == [("b\nc", "d", "e", False), ("A[1", "s", "", False), ("f", "", "", True)]
    assert r.tags == ["y", "w", "si"]


def test_blocks_and_seams():
    kinds = lambda t: [(k, len(ls)) for k, ls in md.blocks(t)]
    assert kinds("a | b\n-\nc") == [("paragraph", 3)] and kinds("a | b\n--|--\n1 | 2\nc") == [("table", 3), ("paragraph", 1)]
    assert kinds("    - x\ny") == [("paragraph", 2)] and kinds("1234567890. x") == [("paragraph", 1)] and kinds("   2) x\n z\nw") == [("list", 2), ("paragraph", 1)]
    assert kinds("> [!note] a\n> b\n  c\nd") == [("callout", 3), ("paragraph", 1)]
    assert kinds("````py\n```\nx\n````\nfin") == [("code", 4), ("paragraph", 1)] and kinds("~~~\nx\n\n") == [("code", 4)]
    code = "```py\n" + "\n".join(f"linea {i}" for i in range(60)) + "\n```"
    for p in md.pieces("code", code.split("\n"), 150):
        assert p.startswith("```py\nlinea") and p.endswith("\n```") and len(p) <= 150
    table = ["a | b", "--|--", *(f"{i} | fila" for i in range(40))]
    cut = md.pieces("table", table, 120)
    assert all(p.startswith("a | b\n--|--\n") for p in cut) and [x for p in cut for x in p.split("\n")[2:]] == table[2:]


def test_chunks_with_overlap():
    lines = [f"parrafo numero {i} con algo de texto" for i in range(40)]
    text = "\n\n".join(lines)
    got = md.split_text(text, 200, 60)
    assert got[0].split("\n\n") == lines[:5] and got[1].split("\n\n")[0] == lines[4] and all(len(c) <= 262 for c in got)
    assert md.split_text(text, 200, 0) == ["\n\n".join(lines[a : a + 5]) for a in range(0, 40, 5)]
    assert md.split_text("x" * 450, 200, 50) == ["x" * 200, "x" * 200, "x" * 50] and md.split_text("  ", 10, 2) == [] and md.split_text(" a ", 10, 2) == ["a"]
    assert md.last_lines("a\n```\nb", 100) == "" and md.last_lines("uno\ndos", 4) == "dos" and md.last_lines("uno\ndos", 3) == ""


def test_folding_of_all_letters(spark):
    import unicodedata

    words = ["Łódź", "información", unicodedata.normalize("NFD", "información ÑANDÚ"), "ΆΣ Ωραία", "ДЁЖ", "ﬁn STRASSE ẞß", "ĳsland", "Ǆ", "tiếng Việt", "İstanbul", "plain ASCII"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", fold("w").alias("f"), fold_letters(F.col("w")).alias("g"), lexical_terms(F.col("w")).alias("t")).collect()
    assert all(r.f == r.g for r in rows), [r for r in rows if r.f != r.g]
    assert rows[1].t == ["informacion"] and rows[2].t == ["informacion", "nandu"] and rows[5].t == ["fin", "strasse", "ssss"]


def test_last_chunk_that_repeats_is_kept():
    """a text of one repeated word lost its last chunk, because it read like the one before."""
    text = "Eaha" * 450  # three stretches of 600
    assert md.split_text(text, 600, 0) == ["Eaha" * 150] * 3
    assert "".join(c["content"] for c in md.note_chunks(text, 600, 0)) == text


def test_results_come_in_slices_of_bounded_bytes(spark, monkeypatch):
    """whole Arrow batches of results were held; a slice is bounded by its bytes, and no row is lost."""
    import pyarrow as pa

    texts = ["a" * 10, None, "é" * 50, "", "b" * 200, "c"]
    cut = list(md.slices(pa.array(texts), 100))
    assert [len(x) for x in cut] == [2, 2, 1, 1] and [t for x in cut for t in x.to_pylist()] == texts
    assert not list(md.slices(pa.array([], pa.string())))
    rows = [(i, f"# T{i}\n" + "palabra " * (i % 7) * 900 + f"^fin{i}") for i in range(300)] + [(300, None)]
    got = spark.createDataFrame(rows, "doc_id long, body string").coalesce(1).select("doc_id", md.blocks_meta(F.col("body")).alias("m"), md.section_array(F.col("body")).alias("s")).collect()
    want = {i: (b or "") for i, b in rows}
    assert len(got) == 301 and all(r.m["plain"] == want[r.doc_id] and dict(r.m["anchors"]) == md.anchors(want[r.doc_id]) for r in got)
    assert all([(x["heading"], x["content"]) for x in r.s] == md.sections(want[r.doc_id]) for r in got)


def front_readings(df):
    """How often a query over the status alone looks for the block of a text."""
    plan = notes.with_title_status(notes.parse_frontmatter(df)).filter("status <> ''").select("status")._jdf.queryExecution().optimizedPlan()
    return plan.toString().count("A---")


def test_frontmatter_is_read_a_few_times_a_row(spark):
    """Lambdas and columns took the block apart again for each of its lines and each use."""
    raw = "---\n" + "".join(f"k{i}: v{i}\n" for i in range(40)) + "k0: last\nl: [a, 'b, c']\nm:\n- x\n- y\n---\n# T\n" + "texto " * 2000
    df = spark.createDataFrame([(raw, "n.md")], "raw string, path string")
    row = notes.parse_frontmatter(df).collect()[0]
    assert len(row.metadata) == 42 and row.metadata["k0"] == "last" and row.lists == {"l": ["a", "b, c"], "m": ["x", "y"]} and row.body == "# T\n" + "texto " * 2000
    assert front_readings(df) <= 8
