import glob
import io
import os
import shutil
import subprocess
import zipfile

import pyarrow as pa
import pytest

from bytelake.__main__ import default_output, main
from bytelake.functions import signatures as G
from bytelake.recon import expr as X
from bytelake.recon.rewrite import simplify
from bytelake.recon.source import class_source
from bytelake.sources.classes import DECODED, ClassTables
from bytelake.sources.classfile import decode
from bytelake.streaming.watch import watch

needs_javac = pytest.mark.skipif(shutil.which("javac") is None, reason="no compiler")

LOOP = """
public class Loop {
  public static void main(String[] args) {
    int sum = 0;
    for (int i = 0; i < 5; i++) { if (i % 2 != 0) { sum += i; } else { System.out.println("even " + i); } }
    System.out.println(sum);
  }
}
"""
TRY = """
public class Try {
  static int COUNT;
  int parse(String s) { try { return Integer.parseInt(s); } catch (NumberFormatException e) { return -1; } }
  int multi(String s) {
    try { if (s == null) throw new IllegalStateException("null"); return s.length(); }
    catch (IllegalStateException | NumberFormatException e) { return 0; } catch (IllegalArgumentException e) { throw e; }
  }
  int fin(int a) { int r = 0; try { r = a / 2; if (a > 5) return r; } catch (RuntimeException e) { r = 9; } finally { COUNT++; } return r; }
  void res(String p) throws Exception { try (java.io.FileReader r = new java.io.FileReader(p)) { r.read(); } }
  void lock(Object o) { synchronized (o) { COUNT += 2; } }
}
"""
MANY = """
import java.util.*;
public class Many {
  enum Color { RED, GREEN(3), BLUE; final int n; Color() { this(0); } Color(int n) { this.n = n; } }
  interface Shape<T extends Comparable<T>> { T area(); default int two() { return 2; } }
  static int COUNT = 7; static final List<String> NAMES = new ArrayList<>(); static { NAMES.add("x"); }
  boolean logic(int a, int b, boolean c) { return (a > 3 && b < 4) || c; }
  boolean mixed(int a, int b, boolean c) { if ((a > 3 || b < 4) && !c) { return a == b; } return c; }
  String tern(int a) { return a > 0 ? "pos" : a < 0 ? "neg" : "zero"; }
  int sw(int k) { int r; switch (k) { case 1: case 2: r = 5; break; case 7: r = 8; default: r = 1; } return r; }
  String str(String s) { switch (s) { case "one": return "1"; case "two": return "2"; default: return "?"; } }
  long loops(int[] xs, List<String> l) {
    long t = 0; for (int x : xs) { if (x == 3) continue; if (x == 9) break; t += x; }
    for (String s : l) { t += s.length(); }
    int i = 0; do { i++; t *= 2; } while (i < 10 && t > 0 && t < 100000);
    while (true) { t--; if (t < 50) break; }
    outer: for (int a = 0; a < 3; a++) for (int b = 0; b < 3; b++) { if (a * b == 2) continue outer; if (a + b == 9) break outer; t++; }
    return t;
  }
  int lam(int q) { java.util.function.Function<String, Integer> f = String::length; java.util.function.IntBinaryOperator g = (a, b) -> a + b * q; return f.apply("abc") + g.applyAsInt(2, 3); }
  int[] arr() { int[] a = {1, 2, 3}; a[1] += 4; int[][] m = new int[3][4]; m[0][a[0]++] = 2; return a; }
  String cat(Object o, char c, double d) { String s = "a" + o + c + d + 'x'; s += 1; return s; }
  float fl(double d) { return 1.5f + (float) d; }
  Object gen(Map<String, ? extends List<Integer>> m) { Integer k = m.get("a").get(0); return k == null ? "none" : k; }
  int nested(String s) { try { try { return s.length(); } finally { COUNT--; } } catch (NullPointerException e) { return 3; } }
  char ch(int i) { char c = 'a'; c += i; return c == 'c' ? '\\n' : c; }
  boolean not(boolean a, Object o) { if (!a || !(o instanceof String)) return false; boolean b = a != (o == null); return !b; }
  boolean tri(Integer v, Integer t, Integer f) { if (v == null) { if (t == null) return true; if (f == null) return false; } else { if (v.equals(t)) return true; if (v.equals(f)) return false; } throw new IllegalArgumentException("no"); }
  String strip(String s, String c) { int e = s.length(); if (c == null) { while (e != 0 && Character.isWhitespace(s.charAt(e - 1))) e--; } else { while (e != 0 && c.indexOf(s.charAt(e - 1)) != -1) e--; } return s.substring(0, e); }
  int assign(Iterator<Integer> it) { int n = 0, x; while (it.hasNext() && (x = it.next()) != 3) { n += x; } return n; }
}
"""
CHECK = """
import java.util.*;
public class Check {
  public static void main(String[] args) {
    Many m = new Many();
    StringBuilder b = new StringBuilder();
    for (int i = -6; i < 12; i++) {
      b.append(m.logic(i, i, i % 2 == 0)).append(m.mixed(i, 4, i > 4)).append(m.tern(i)).append(m.sw(i)).append(m.ch(i)).append(m.fl(i)).append(m.lam(i));
      b.append(m.not(i > 2, i % 3 == 0 ? "s" : (Object) i)).append(m.cat(i, (char) (70 + i), i / 2.0));
    }
    b.append(m.str("one")).append(m.str("two")).append(m.str("x")).append(m.loops(new int[] {1, 3, 4, 9, 5}, Arrays.asList("a", "bcd")));
    b.append(Arrays.toString(m.arr())).append(m.nested(null)).append(m.nested("abc")).append(Many.COUNT).append(m.assign(Arrays.asList(1, 2, 3, 4).iterator()));
    b.append(m.gen(Collections.singletonMap("a", Arrays.asList(5)))).append(m.gen(Collections.singletonMap("a", Arrays.asList((Integer) null)))).append(Many.NAMES);
    b.append(m.tri(null, null, 1)).append(m.tri(null, 1, null)).append(m.tri(4, 4, 5)).append(m.tri(5, 4, 5)).append(m.strip("ab  ", null)).append(m.strip("abcc", "cb"));
    try { m.tri(6, 4, 5); } catch (IllegalArgumentException e) { b.append(e.getMessage()); }
    Try t = new Try();
    b.append(t.parse("12")).append(t.parse("x")).append(t.multi(null)).append(t.multi("abc")).append(t.fin(4)).append(t.fin(9)).append(Try.COUNT);
    t.lock("x"); b.append(Try.COUNT);
    System.out.println(b);
  }
}
"""


def row(data, path):
    r = decode(data)
    d = {"class_id": "x", "archive": "", "path": path, "n_bytes": len(data), "deprecated": False} | r.root | r.tables
    return pa.RecordBatch.from_pylist([d], DECODED).to_pylist()[0]


def compiled(folder, sources, *flags):
    for name, text in sources.items():
        (folder / f"{name}.java").write_text(text)
    out = folder / "out"
    subprocess.run(["javac", "-nowarn", *flags, "-d", str(out), *[str(folder / f"{n}.java") for n in sources]], check=True, capture_output=True)
    return {os.path.basename(p)[:-6]: open(p, "rb").read() for p in sorted(glob.glob(f"{out}/*.class"))}


def source(data, name="X.class"):
    return class_source(row(data, name))


@needs_javac
def test_anchors_without_debug_tables(tmp_path):
    got = compiled(tmp_path, {"Loop": LOOP, "Try": TRY}, "-g:none", "--release", "8")
    loop = source(got["Loop"]).text
    for anchor in ("public class Loop", "public static void main(String[] arg0)", "for (int var_2 = 0; var_2 < 5; var_2++)", "if ((var_2 % 2) != 0)", "var_1 += var_2;", "} else {", 'System.out.println("even " + var_2);', "System.out.println(var_1);"):
        assert anchor in loop, loop
    text = source(got["Try"]).text
    for anchor in ("try {", "catch (NumberFormatException e)", "IllegalStateException | NumberFormatException e", "catch (IllegalArgumentException e)", "return -1;", "return 0;", "finally {", "synchronized (arg0)"):
        assert anchor in text, text


@needs_javac
@pytest.mark.parametrize("release", ["8", "11", "17"])
@pytest.mark.parametrize("debug", ["-g", "-g:none"])
def test_source_compiles_and_runs_alike(tmp_path, release, debug):
    """Source of compiled classes, compiled again, prints the same."""
    got = compiled(tmp_path, {"Many": MANY, "Try": TRY, "Check": CHECK}, debug, "--release", release)
    want = subprocess.run(["java", "-cp", str(tmp_path / "out"), "Check"], capture_output=True, text=True, check=True).stdout
    again = tmp_path / "again"
    again.mkdir()
    for name in ("Many", "Try"):
        s = source(got[name], f"{name}.class")
        assert s.unstructured == 0, s.text
        (again / f"{name}.java").write_text(s.text)
    (again / "Check.java").write_text(CHECK)
    r = subprocess.run(["javac", "-nowarn", "-d", str(again / "out"), *glob.glob(f"{again}/*.java")], capture_output=True, text=True)
    assert r.returncode == 0, r.stderr + (again / "Many.java").read_text()
    assert subprocess.run(["java", "-cp", str(again / "out"), "Check"], capture_output=True, text=True, check=True).stdout == want


@needs_javac
def test_members(tmp_path):
    got = compiled(tmp_path, {"Many": MANY}, "-g")
    color, shape = source(got["Many$Color"], "Many$Color.class").text, source(got["Many$Shape"], "Many$Shape.class").text
    assert "GREEN(3)" in color and "values()" not in color and "super(" not in color and "this(0);" in color
    assert "interface Many$Shape<T extends Comparable<T>>" in shape and "T area();" in shape and "default int two()" in shape


@needs_javac
def test_damage_gives_a_stub(tmp_path):
    data = compiled(tmp_path, {"Try": TRY})["Try"]
    for n in (0, 1, 4, 8, 10, 20, 100, len(data) - 3):
        assert "class" in source(data[:n], "a/Try.class").text
    for k in range(10, len(data), 3):
        assert "class" in source(data[:k] + bytes([data[k] ^ 0x55]) + data[k + 1 :], "a/Try.class").text


def test_signatures():
    assert G.field_type("Ljava/util/List<Ljava/lang/String;>;") == "java.util.List<java.lang.String>"
    assert G.field_type("[[TT;") == "T[][]" and G.field_type("Ljava/util/Map<*+La/B;-[I>;") == "java.util.Map<?, ? extends a.B, ? super int[]>"
    m = G.method_type("<T:Ljava/lang/Object;U::Ljava/lang/Comparable<TU;>;>(TT;I)TU;^TX;")
    assert (m.parameters, m.result, m.throws, m.variables) == (["T", "int"], "U", ["X"], ["T", "U extends java.lang.Comparable<U>"])
    c = G.class_type("<K:Ljava/lang/Object;>La/S<TK;>;La/I;")
    assert (c.super_name, c.interfaces, c.variables) == ("a.S<K>", ["a.I"], ["K"])
    assert G.method_types("(II)V", "(I)V").parameters == ["int", "int"] and G.field_types("I", "broken") == "int"
    for bad in ("", "[", "L", "Lx", "Q", "II", "(I", "Ljava/util/List<", "<"):
        with pytest.raises(G.Malformed):
            G.field_type(bad)
    with pytest.raises(G.Malformed):
        G.field_type("La<" * 200 + "I" + ">;" * 200)


def test_literals():
    assert X.escape('a\nb\rc\td"e\f\x01g\\') == 'a\\nb\\rc\\td\\"e\\f\\u0001g\\\\'
    assert X.real_literal(float("nan"), "float") == "Float.NaN" and X.real_literal(1.0, "float") == "1.0f" and X.real_literal(float("-inf"), "double") == "Double.NEGATIVE_INFINITY"


def test_conditions():
    v, o = X.var("flag", "boolean"), X.var("o", "a.B")
    num = lambda n: X.const(str(n), "int")
    no = lambda e: X.E("not", [e], type="boolean")
    text = lambda e: X.render(simplify(e))
    assert text(no(no(v))) == "flag" and text(no(X.binary("==", o, X.const("null", "null"), "boolean"))) == "o != null"
    assert text(no(X.binary("!=", num(1), num(0), "boolean"))) == "false"
    assert text(X.binary("!=", X.binary("-", X.var("a", "int"), X.var("b", "int"), "int"), num(0), "boolean")) == "(a - b) != 0"
    real = X.binary("<", X.var("x", "double"), X.var("y", "double"), "boolean")
    real.more = "real"
    assert text(no(real)) == "!(x < y)"


@needs_javac
def test_command_line_and_stream(spark, tmp_path, capsys):
    got = compiled(tmp_path, {"Loop": LOOP, "Many": MANY})
    one = tmp_path / "Loop.class"
    one.write_bytes(got["Loop"])
    assert main([str(one)]) == 0 and "class Loop" in capsys.readouterr().out
    assert main([str(one), "-o", str(tmp_path / "L.java")]) == 0 and "class Loop" in (tmp_path / "L.java").read_text()
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n, data in got.items():
            z.writestr(f"{n}.class", data)
    (tmp_path / "in").mkdir()
    jar = tmp_path / "in" / "x.jar"
    jar.write_bytes(raw.getvalue())
    assert main([str(jar), "-o", str(tmp_path / "o.zip"), "-p", str(tmp_path / "none")]) == 0
    with zipfile.ZipFile(tmp_path / "o.zip") as z:
        assert "Many.java" in z.namelist()
    assert main([str(jar), "-m"]) == 0 and os.path.exists(default_output(str(jar)) + "/Many.java")
    assert "enum Color" in open(default_output(str(jar)) + "/Many.java").read().replace("Many$", "")
    assert main([str(tmp_path / "missing.jar")]) == 2
    q = watch(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "state"), once=True)
    q.awaitTermination(120)
    assert ClassTables(spark.read.parquet(str(tmp_path / "table"))).insns.count() > 100
