import os
import random
import re
import subprocess
import zipfile

import pytest

from bytelake.functions import names as N
from bytelake.operators import cfg, graph, hierarchy, resolve, scopes, sources, trees
from bytelake.plans.bytecode import sample_archive
from bytelake.sources.classes import ClassTables, archive_entries, files
from bytelake.sources.zips import stored
from tests.builder import ClassBuilder

JAR = sample_archive()
pytestmark = pytest.mark.skipif(not os.path.exists(JAR), reason="no archive")


@pytest.fixture(scope="module")
def jar(spark):
    return ClassTables.scan(spark, JAR)


def folder(tmp_path, builders):
    (tmp_path / "own.jar").write_bytes(stored([(f"{n}.class", b.build() if hasattr(b, "build") else b) for n, b in builders.items()]))
    return str(tmp_path / "own.jar")


@pytest.fixture(scope="module")
def javap(tmp_path_factory):
    at = tmp_path_factory.mktemp("classes")
    with zipfile.ZipFile(JAR) as z:
        z.extractall(at)
    found = sorted(str(p) for p in at.rglob("*.class") if not re.search(r"(module|package)-info\.class$", str(p)))
    return subprocess.run(["javap", "-v", "-p", *found], capture_output=True, text=True, check=True).stdout


def test_counts_equal_javap(jar, javap):
    assert jar.classes.where("status = 'ok'").count() == len(re.findall(r"^Classfile ", javap, re.M)) == 218
    assert jar.cp.where("status = 'present'").count() == len(re.findall(r"^ *#\d+ = ", javap, re.M))
    assert jar.insns.count() == len(re.findall(r"^ +\d+: [a-z][a-z0-9_]*( |$)", javap, re.M))
    assert jar.methods.where("code IS NOT NULL").count() == len(re.findall(r"^    Code:", javap, re.M))
    rows = re.findall(r"^ +(\d+) +(\d+) +(\d+) +(Class \S+|any)$", javap, re.M)
    assert jar.handlers.count() == len(rows)
    assert jar.frames.count() == sum(int(n) for n in re.findall(r"StackMapTable: number_of_entries = (\d+)", javap))


def test_references_equal_javap(jar, javap):
    mine = {(r.owner.replace(".", "/"), r.name, r.descriptor) for r in resolve.references(jar).where("owner IS NOT NULL").collect()}
    theirs = {(a, b.strip('"'), c) for a, b, c in re.findall(r"^ *#\d+ = (?:Interface)?(?:Method|Field)ref +\S+ +// +([^ .]+)\.([^:]+):(\S+)$", javap, re.M)}
    assert len(theirs) > 1500 and {x for x in theirs if not x[0].startswith('"')} <= mine


def test_entries(spark):
    rows = archive_entries(files(spark, JAR)).selectExpr("path", "status", "crc32(content) = crc32 AS ok").collect()
    assert len(rows) == 244 and all(r.status == "ok" and r.ok for r in rows)


def test_unresolved_references_keep_their_rows(spark, tmp_path):
    b = ClassBuilder()
    b.add(10, b"\x00\xfa\x00\xfb")
    b.add(9, b"\x00\xfa\x00\xfb")
    t = ClassTables.scan(spark, folder(tmp_path, {"a/B": b}))
    got = {(r.kind, r.name, r.descriptor) for r in resolve.references(t).collect()}
    assert {re.sub(r"\d+", "N", n) for _, n, _ in got} == {"method#N", "field#N"}


def test_hierarchy(spark, tmp_path):
    parent = ClassBuilder("p/Parent", interfaces=["p/Greeter"])
    for name, desc, access in (("direct", "()V", 1), ("helper", "()V", 2), ("util", "()V", 9), ("<init>", "()V", 1)):
        parent.method(name, desc, access)
    face = ClassBuilder("p/Greeter", access=0x601)
    face.method("greet", "(I)V", 0x401)
    child = ClassBuilder("p/Child", "p/Parent")
    for name, desc in (("direct", "()V"), ("greet", "(I)V"), ("helper", "()V"), ("util", "()V"), ("missing", "()V"), ("<init>", "()V"), ("greet", "(J)V"), ("toString", "()Ljava/lang/String;")):
        child.method(name, desc)
    rows = {"p/Parent": parent, "p/Greeter": face, "p/Child": child, "p/A": ClassBuilder("p/A", "p/B"), "p/B": ClassBuilder("p/B", "p/A"), "p/Broken": b"\xca\xfe\xba\xbe\x00"}
    t = ClassTables.scan(spark, folder(tmp_path, rows))
    assert {(r.name, r.descriptor, r.ancestor) for r in hierarchy.overrides(t).collect()} == {("direct", "()V", "p.Parent"), ("greet", "(I)V", "p.Greeter")}
    above = {(r.name, r.ancestor) for r in hierarchy.ancestors(resolve.class_headers(t)).collect()}
    assert {("p.Child", "p.Greeter"), ("p.Child", "java.lang.Object"), ("p.A", "p.B"), ("p.A", "p.A")} <= above
    assert [r.name for r in hierarchy.object_overrides(t).collect()] == ["toString"]
    top = ClassBuilder("java/lang/Object", None)
    top.method("toString", "()Ljava/lang/String;")
    os.makedirs(tmp_path / "top")
    assert hierarchy.object_overrides(ClassTables.scan(spark, folder(tmp_path / "top", {"java/lang/Object": top}))).count() == 0
    assert {(r.n_classes, r.n_failed) for r in scopes.scan_summary(t).collect()} == {(6, 1)}
    one, two = resolve.class_headers(t).where("name = 'p.A'"), resolve.class_headers(t)
    assert hierarchy.classpath(one, two).count() == 5


def slow_reach(edges, start):
    seen, wait = {start}, [start]
    while wait:
        n = wait.pop()
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                wait.append(b)
    return seen


def test_graphs_equal_brute_force(spark):
    rng = random.Random(11)
    graphs = {m: (n := rng.randrange(1, 9), sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))})) for m in range(120)}
    nodes = [("c", m, k) for m, (n, _) in graphs.items() for k in range(n)]
    found = spark.createDataFrame(nodes, "class_id string, method int, start_pc int")
    edges = spark.createDataFrame([("c", m, a, b, "branch") for m, (_, es) in graphs.items() for a, b in es], "class_id string, method int, a int, b int, kind string")
    live, idom, loops = {}, {}, {}
    for r in cfg.reachable_blocks(found, edges).collect():
        live.setdefault(r.method, set()).add(r.node)
    for r in cfg.dominators(found, edges).collect():
        idom.setdefault(r.method, {})[r.node] = r.idom
    for r in cfg.loops(found, edges).collect():
        loops.setdefault(r.method, {})[r.header] = (set(r.latches), set(r.blocks))
    seeds = spark.createDataFrame([("c", m, 0) for m in graphs], "class_id string, method int, node int")
    by_rounds = {}
    for r in graph.closure(edges.select("class_id", "method", "a", "b").distinct(), seeds, ["class_id", "method"], ["class_id", "method"]).collect():
        by_rounds.setdefault(r.method, set()).add(r.node)
    flat = spark.createDataFrame([(100 * m + a, 100 * m + b) for m, (_, es) in graphs.items() for a, b in es], "a int, b int")
    paths = {(r.a, r.b) for r in graph.transitive(flat).collect()}
    assert paths == {(100 * m + a, 100 * m + x) for m, (_, es) in graphs.items() for a, b in es for x in slow_reach(es, b)}
    back = {}
    for r in cfg.back_edges(found, edges).collect():
        back.setdefault(r.method, set()).add((r.latch, r.header, r.natural))
    for m, (n, es) in graphs.items():
        mine = back.get(m, set())
        left = [e for e in es if e not in {(a, b) for a, b, _ in mine}]
        live_ = slow_reach(es, 0)
        assert not any(k in slow_reach(left, b) for a, b in left if a in live_ for k in (a,)), "a cycle keeps all its edges"
        natural = {(a, b) for a, b in es if a in live_ and (b == a or a not in slow_reach([e for e in es if b not in e], 0) or b == 0)}
        assert {(a, b) for a, b, x in mine if x} == natural
    for m, (n, es) in graphs.items():
        reach = slow_reach(es, 0)
        assert live[m] == reach == by_rounds[m]
        dom = {k: {d for d in reach if d == k or k not in slow_reach([e for e in es if d not in e], 0) - {d} or d == 0} for k in reach}
        want = {}
        for k in reach:
            strict = dom[k] - {k}
            assert idom[m][k] == (max(strict, key=lambda d: len(dom[d])) if strict else None)
            for a, b in es:
                if a == k and b in dom[k]:
                    inside = {b} | {x for x in range(n) if x in reach and x != b and a in slow_reach([e for e in es if b not in e], x)}
                    ends, all_inside = want.get(b, (set(), set()))
                    want[b] = (ends | {a}, all_inside | inside | {a})
        assert loops.get(m, {}) == want


def test_blocks_and_loops_of_code(spark, tmp_path):
    b = ClassBuilder()
    b.method("loop", "(I)V", 9, [b.code(bytes.fromhex("03" "3c" "1b" "9a0009" "840101" "a7fff9" "b1"))])
    b.method("dead", "()V", 9, [b.code(bytes.fromhex("b1" "00" "00" "b1"))])
    t = ClassTables.scan(spark, folder(tmp_path, {"a/B": b}))
    found = cfg.blocks(t)
    assert sorted((r.method, r.start_pc, r.end_pc) for r in found.collect()) == [(0, 0, 2), (0, 2, 6), (0, 6, 12), (0, 12, 13), (1, 0, 1), (1, 1, 4)]
    edges = cfg.block_edges(t, found)
    assert sorted((r.a, r.b, r.kind) for r in edges.collect()) == [(0, 2, "fall"), (2, 6, "fall"), (2, 12, "branch"), (6, 2, "branch")]
    live = cfg.reachable_blocks(found, edges)
    assert [(r.method, r.start_pc, r.end_pc) for r in cfg.dead_runs(t, found, live).collect()] == [(1, 1, 4)]
    assert [(r.header, r.latches, r.blocks, r.kind) for r in cfg.loops(found, edges).collect()] == [(2, [6], [2, 6], "while")]
    assert [(r.pc, r.target) for r in scopes.backward_jumps(t).collect()] == [(9, 2)]


def test_locals(jar):
    rows = scopes.locals_at(jar)
    assert rows.count() == jar.insns.where("var IS NOT NULL").count()
    assert rows.where("name RLIKE '^local[0-9]+$' AND type IS NOT NULL").count() == 0 and rows.where("name = 'this'").count() > 1000


def test_frames_lie_on_instructions(jar):
    frames = scopes.frame_offsets(jar)
    assert frames.join(jar.insns, ["class_id", "method", "pc"], "left_anti").count() == 0
    assert frames.join(jar.frames.select("class_id", "method", "seq", "pc"), ["class_id", "method", "seq", "pc"], "left_anti").count() == 0


NAMES = [
    ("(IILjava/lang/String;)V", ["int", "int", "java.lang.String"], "void"), ("()Ljava/lang/Object;", [], "java.lang.Object"), ("([B[I)V", ["byte[]", "int[]"], "void"), ("([[La/B;J)[D", ["a.B[][]", "long"], "double[]"),
]


def test_descriptors(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(d,) for d, _, _ in NAMES], "d string").select("d", N.parameter_types(F.col("d")).alias("p"), N.return_type(F.col("d")).alias("r"), N.is_method_descriptor(F.col("d")).alias("ok")).collect()
    assert {(r.d, tuple(r.p), r.r) for r in rows} == {(d, tuple(p), r) for d, p, r in NAMES} and all(r.ok for r in rows)
    bad = spark.createDataFrame([("(I",), ("[",), ("Lx",), ("",)], "d string").select(N.field_type(F.col("d")).alias("t"), N.is_method_descriptor(F.col("d")).alias("ok")).collect()
    assert all(r.t is None and not r.ok for r in bad)


def test_name_functions(spark):
    from pyspark.sql import functions as F

    one = lambda text, f: spark.createDataFrame([(text,)], "x string").select(f(F.col("x"))).first()[0]
    assert one("java.util.Map<java.lang.String, a.b.C$D[]>", N.short_type) == "Map<String, C$D[]>"
    assert [one(x, N.readable_name) for x in ("a", "", "ab", "12", "name", "é")] == ["var_a", "local_", "local_ab", "field_12", "name", "field_é"]
    assert one("Foo x = new Foo(); AF y = of; $Foo Foo$", lambda c: N.rename_word(c, "Foo", "F_0")) == "F_0 x = new F_0(); AF y = of; $Foo Foo$"
    assert one("a.b.C$D", N.short_annotation_name) == "D" and one("a.b.C", N.package_of) == "a.b"


def test_sources_and_sinks(spark, jar, tmp_path):
    found = sources.sources(jar)
    rows = found.collect()
    assert len(rows) == 218 and all(r.error is None for r in rows) and sum(r.n_unstructured for r in rows) <= 12
    marked = sources.sources_with_overrides(jar)
    assert sum(r.text.count("@Override") for r in marked.collect()) > 200
    merged = sources.merge_inner(jar, found)
    assert 100 < merged.count() < 218
    assert sources.write_tree(found, str(tmp_path / "out")) == 218
    assert len(list((tmp_path / "out").rglob("*.java"))) == 218
    archive = sources.zip_archives(found).first()
    (tmp_path / "s.zip").write_bytes(archive.content)
    with zipfile.ZipFile(tmp_path / "s.zip") as z:
        assert len(z.namelist()) == 218


def test_trees(jar):
    nodes = trees.ast_nodes(jar).cache()
    assert nodes.count() > 10_000 and nodes.where("parent >= node").count() == 0 and trees.after_return(nodes).count() == 0
    parents = nodes.select("class_id", "method", nodes["node"].alias("parent"))
    assert nodes.where("parent >= 0").join(parents, ["class_id", "method", "parent"], "left_anti").count() == 0
    locals_ = trees.local_types(jar).cache()
    # where debug tables name a variable, the inferred name is that one
    named = scopes.locals_at(jar).where("type IS NOT NULL").select("class_id", "method", "pc", "slot", "name")
    both = named.join(locals_.select("class_id", "method", "pc", "slot", locals_["name"].alias("inferred")), ["class_id", "method", "pc", "slot"])
    assert both.count() > 3500 and both.where("name <> inferred").count() == 0
    assert trees.final_local_types(locals_).groupBy("class_id", "method", "slot").count().where("count > 1").count() == 0
    assert trees.condition_names(nodes).count() > 20 and trees.assignment_counts(nodes).count() > 300


def test_names_deep_in_conditions(spark):
    # if ((((a && b) && c) && d) && !e), and f == g, which is no logic
    rows = [(0, -1, "stmt", 0, "if", None), (1, 0, "expr", 0, "bin", "&&"), (2, 1, "expr", 0, "bin", "&&"), (3, 2, "expr", 0, "bin", "&&"), (4, 3, "expr", 0, "bin", "&&")]
    rows += [(5, 4, "expr", 0, "var", "a"), (6, 4, "expr", 1, "var", "b"), (7, 3, "expr", 1, "var", "c"), (8, 2, "expr", 1, "var", "d"), (9, 1, "expr", 1, "not", None), (10, 9, "expr", 0, "var", "e")]
    rows += [(11, -1, "stmt", 1, "while", None), (12, 11, "expr", 0, "bin", "=="), (13, 12, "expr", 0, "var", "f"), (14, 12, "expr", 1, "var", "g")]
    nodes = spark.createDataFrame([("C", 0, *r, None, None, None) for r in rows], trees.NODES)
    assert {r.name for r in trees.condition_names(nodes).collect()} == set("abcde")


def test_statements_behind_the_end_of_inner_blocks(spark):
    rows = [(0, -1, 0, "if", 0), (1, 0, 0, "return", 0), (2, 0, 1, "expr", 1), (3, 0, 2, "break", 1), (4, 0, 3, "expr", 1), (5, -1, 1, "return", 0)]
    nodes = spark.createDataFrame([("C", 0, n, p, "stmt", k, kind, None, None, None, b) for n, p, k, kind, b in rows], trees.NODES)
    assert [r.node for r in trees.after_return(nodes).collect()] == [4]


def test_paths_that_differ_by_case(spark):
    rows = [("1", "", "F.java", "F", "class F { F f = new F(); }"), ("2", "", "f.java", "f", "class f { f x = new f(); }"), ("3", "", "Plain.java", "Plain", "class Plain { f y; }"), ("4", "", "f_0.java", "f_0", "class f_0 {}")]
    found = spark.createDataFrame([(*r, 0, 0, None) for r in rows], sources.SOURCES)
    got = {r.class_id: (r.path, r.text) for r in sources.unique_paths(found).collect()}
    assert got["1"] == rows[0][2:3] + rows[0][4:] and got["3"][1] == rows[2][4] and got["4"][0] == "f_0.java"
    assert got["2"] == ("f_1.java", "class f_1 { f_1 x = new f_1(); }") and len({p.lower() for p, _ in got.values()}) == 4


def test_next_free_numbers(spark):
    paths = ["a/B.java", "a/b.java", "A/b.java", "a/B_0.java", "a/b_2.java", "c/B_0.java", "a/b_03.java", "B.java"]
    found = spark.createDataFrame([(str(k), f"x{k}.jar", p, "n", "", 0, 0, None) for k, p in enumerate(paths)], sources.SOURCES)
    got = {r.class_id: r.path for r in sources.unique_paths(found, ()).collect()}
    assert got == {"0": "a/B_1.java", "1": "a/b_3.java", "2": "A/b.java"} | {str(k): paths[k] for k in range(3, 8)}
    assert {r.path for r in sources.unique_paths(found).collect()} == set(paths)


def test_types_are_renamed_where_they_are_types(spark):
    text = """public final class a<T extends a> extends b implements a, c {
    // a stays here; a.class too
    private a a = new a(1);
    static a[] all;
    String s = "a a.class " + 'a';
    public a(int a) throws a {
        this.a = a;
        a(a);
        Object o = (a) x;
        List<a> l = Arrays.asList(a.class, a::get, a[].class);
        if (o instanceof a && a instanceof b) { a.a = a + a; }
    }
    a a(a... a) { return a; }
}"""
    want = """public final class a_0<T extends a_0> extends b implements a_0, c {
    // a stays here; a.class too
    private a_0 a = new a_0(1);
    static a_0[] all;
    String s = "a a.class " + 'a';
    public a_0(int a) throws a_0 {
        this.a = a;
        a(a);
        Object o = (a_0) x;
        List<a_0> l = Arrays.asList(a_0.class, a_0::get, a_0[].class);
        if (o instanceof a_0 && a instanceof b) { a.a = a + a; }
    }
    a_0 a(a_0... a) { return a; }
}"""
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text, "a", "a_0")], "t string, o string, n string").select(N.rename_type(F.col("t"), F.col("o"), F.col("n"))).first()[0] == want


def test_trees_and_zips_lose_nothing(spark, tmp_path):
    """Plain class files in folders, and two archives that share names, as one tree and as one zip."""
    root = tmp_path / "in"
    for k in (1, 2):
        (root / "lib").mkdir(parents=True, exist_ok=True)
        (root / "lib" / f"x{k}.jar").write_bytes(stored([(f"p/{n}.class", ClassBuilder(f"p/{n}").build()) for n in ("A", "a", "B")]))
    for n in ("A", "C"):
        (root / "plain" / "p").mkdir(parents=True, exist_ok=True)
        (root / "plain" / "p" / f"{n}.class").write_bytes(ClassBuilder(f"p/{n}").build())
    found = sources.sources(ClassTables.scan(spark, str(root)))
    out = tmp_path / "out"
    want = {f"lib/x{k}/p/{n}.java" for k in (1, 2) for n in ("A", "a_0", "B")} | {"plain/p/A.java", "plain/p/C.java"}
    assert sources.write_tree(found, str(out)) == 8
    files = {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file()}
    assert set(files) == want and "class a_0" in files["lib/x1/p/a_0.java"]
    assert sources.write_zip(found, str(tmp_path / "out.zip")) == 8
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert z.testzip() is None and {n: z.read(n).decode() for n in z.namelist()} == files
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out", "out.zip"]
    one = sources.sources(ClassTables.scan(spark, str(root / "plain" / "p" / "C.class")))
    assert sources.write_tree(one, str(tmp_path / "one")) == 1 and (tmp_path / "one" / "C.java").exists()
    assert sources.write_zip(found.limit(0), str(tmp_path / "none.zip")) == 0 and zipfile.ZipFile(tmp_path / "none.zip").namelist() == []


def test_imports_of_merged_classes(jar):
    found = sources.sources(jar)
    merged = {r.class_name: r.text for r in sources.merge_inner(jar, found).collect()}
    text = merged["com.google.gson.internal.LinkedTreeMap"]
    head = text.split("class LinkedTreeMap")[0]
    assert head.count("import java.util.Iterator;") == 1 and "import java.util.ConcurrentModificationException;" in head and text.count("\npackage ") == 1
    assert "com.google.gson.internal.LinkedTreeMap$Node" not in merged and "LinkedTreeMap$Node" in text


def test_damaged_classes_never_fail_the_job(spark, tmp_path):
    """Truncated, flipped and blanked classes of the archive: each has a row, a source, and the rest of the job is whole."""
    rng, rows = random.Random(4), {}
    with zipfile.ZipFile(JAR) as z:
        names = [n for n in z.namelist() if n.endswith(".class") and "-info" not in n][:60]
        for k, n in enumerate(names):
            data = bytearray(z.read(n))
            how = k % 6
            if how == 0:
                data = data[: rng.randrange(len(data))]
            elif how == 1:
                data[:8] = bytes(8)
            elif how < 5:
                for _ in range((1, 5, 20)[how - 2]):
                    data[rng.randrange(10, len(data))] = rng.randrange(256)
            rows[f"d/{k}"] = bytes(data)
    t = ClassTables.scan(spark, folder(tmp_path, rows))
    found = sources.sources(t).collect()
    assert len(found) == 60 == t.classes.count() and all("class" in r.text or "interface" in r.text or "enum" in r.text for r in found)
    assert t.classes.where("status = 'fatal'").count() >= 20 and t.diagnostics.count() >= 20
    blocks = cfg.blocks(t)
    assert cfg.loops(blocks, cfg.block_edges(t, blocks)).count() >= 0 and scopes.locals_at(t).count() > 0
