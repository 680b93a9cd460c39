"""Java and C++ types found by scanning brackets: nested types, braces in strings and comments, files that do not compile."""

import pytest

from structcheck.sources import declarations, extraction

FILES = "repo string, path string, content string"

JAVA = r"""
package demo; // { brace
import java.util.List; import java.util.Map;
/* class Fake { */
@Entity(name = "x{", value = {1, 2})
public final class Child<T extends Base> extends Base implements Runnable, Comparable<Child> {
    private final String name = "a;{b}";
    static int[] a = {1, 2}, b;
    List<Map<String, Integer>> items = new ArrayList<>(), more[];
    char c = '{', e = '\'';
    String text = \"\"\" { " } \"\"\";
    public Child(String name, int... xs) { this.name = name; }
    public String name() { if (x) { return name; } return "}"; }
    @Override public <R> Map<String, R> get(final List<R> r, Base[] b) throws Exception { Runnable q = () -> { int z = 1; }; class Local { int k; } return null; }
    abstract void none();
    static { int w = 3; }
    Object o = new Object() { int hidden; void f() {} };
    enum Color { RED(1) { void p() {} }, GREEN, BLUE; private final int v = 2; Color(int i) {} }
    interface In { int X = 1; void m(); default int d() { return 1; } class Deep {} }
    protected long last;
}
record Point(int x, List<String> y) { Point { } int x() { return x; } static int Z; }
@interface Note { int value() default 3; }
class Base {}
""".replace(r"\"", '"')

CPP = r"""#pragma once
#define X { \
  {
namespace a { namespace b::c {
class Fwd;
template <typename T> class Tpl { int x; };
enum class Col { RED };
class Animal {
    int secret;
public:
    Animal() : secret(1), t{2} {}
    virtual ~Animal();
    void speak();
    virtual int draw(const std::string& s, int n = 3, std::map<int, int> m = {}) const = 0;
    static Animal* make(int, unsigned int, char *argv[]);
    bool operator==(const Animal &o) const { return true; }
    operator bool() const;
    std::vector<std::pair<int, int>> v, *w;
    static constexpr int K = 4;
    std::function<void(int)> cb;
    void (*fp)(int);
    int arr[10], bits : 3;
    auto f() -> int;
    template <class Q> void t(Q q);
    friend class Z;
    struct Inner { int z; };
protected:
    double d{1.5};
private:
    int p2;
    void hid();
};
struct Dog final : public virtual Animal, private ns::Base<int, X> { void bark() { if (1) { } } int age; };
} }
extern "C" { struct S { int q; }; }
struct { int anon; } var;
// class Gone { };
"""


def types(spark, read, rows, **options):
    return {r["qualifiedName"]: r for r in read(spark.createDataFrame(rows, FILES), **options).collect()}


def fields(t):
    return {f["name"]: f["type"] for f in t["fields"]}


def executables(t):
    return [f"{e['name']}({','.join(p['type'] for p in e['parameters'])}){e['returnType'] or ''}" for e in t["executables"]]


def test_java(spark):
    got = types(spark, declarations.java_types, [("r", "src/A.java", JAVA), ("r", "empty.java", ""), ("r", "null.java", None)], nested=True)
    assert set(got) == {"demo.Child", "demo.Child$Color", "demo.Child$In", "demo.Child$In$Deep", "demo.Point", "demo.Note", "demo.Base"}
    child = got["demo.Child"]
    assert (child["superClass"], child["interfaces"], child["abstractType"], child["finalType"], child["sourceFile"], child["kind"]) == ("demo.Base", ["java.lang.Comparable", "java.lang.Runnable"], False, True, "src/A.java", "class")
    assert fields(child) == {"a": "int[]", "b": "int[]", "c": "char", "e": "char", "items": "java.util.List", "last": "long", "more": "java.util.List[]", "name": "java.lang.String", "o": "java.lang.Object", "text": "java.lang.String"}
    assert list(fields(child)) == sorted(fields(child))
    assert executables(child) == ["get(java.util.List,demo.Base[])java.util.Map", "name()java.lang.String", "none()void", "<init>(java.lang.String,int[])"]
    assert [(e["constructor"], e["abstractExecutable"], e["visibility"]) for e in child["executables"]] == [(False, False, "public"), (False, False, "public"), (False, True, "package-private"), (True, False, "public")]
    assert {f["name"]: (f["visibility"], f["staticField"], f["finalField"]) for f in child["fields"]}["name"] == ("private", False, True)
    assert fields(got["demo.Child$Color"]) == {"RED": "demo.Child$Color", "GREEN": "demo.Child$Color", "BLUE": "demo.Child$Color", "v": "int"}
    assert executables(got["demo.Child$Color"]) == ["<init>(int)"] and got["demo.Child$Color"]["kind"] == "enum"
    assert executables(got["demo.Child$In"]) == ["d()int", "m()void"] and got["demo.Child$In"]["abstractType"] and fields(got["demo.Child$In"]) == {"X": "int"}
    assert executables(got["demo.Point"]) == ["x()int", "y()java.util.List", "<init>(int,java.util.List)"] and fields(got["demo.Point"]) == {"Z": "int", "x": "int", "y": "java.util.List"}
    assert got["demo.Note"]["kind"] == "annotation" and executables(got["demo.Base"]) == ["<init>()"]
    assert set(types(spark, declarations.java_types, [("r", "src/A.java", JAVA)])) == {"demo.Child", "demo.Point", "demo.Note", "demo.Base"}


def test_names_of_a_package_are_those_of_other_files_too(spark):
    rows = [("r", "a/Base.java", "package demo; public class Base {}"), ("r", "a/Child.java", "package demo; import other.Thing; class Child extends Base { Thing t; Far f; }"), ("q", "a/Far.java", "package demo; class Far extends java.lang.Object {}")]
    got = types(spark, declarations.java_types, rows)
    assert got["demo.Child"]["superClass"] == "demo.Base" and fields(got["demo.Child"]) == {"f": "Far", "t": "other.Thing"}  # Far is of another repository
    assert got["demo.Far"]["superClass"] is None


def test_cpp(spark):
    got = types(spark, declarations.cpp_types, [("r", "A.hpp", CPP), ("r", "B.hpp", CPP.replace("secret", "other")), ("r", "empty.hpp", ""), ("r", "null.hpp", None)], nested=True)
    assert set(got) == {"a.b.c.Animal", "a.b.c.Animal.Inner", "a.b.c.Dog", "S"} and {t["path"] for t in got.values()} == {"A.hpp"}
    animal = got["a.b.c.Animal"]
    assert animal["abstractType"] and animal["superClass"] is None and animal["kind"] == "class"
    assert fields(animal) == {"v": "std::vector<std::pair<int, int>>", "w": "std::vector<std::pair<int, int>> *", "K": "const int", "cb": "std::function<void(int)>", "fp": "void (*)(int)", "arr": "int[10]", "bits": "int", "d": "double"}
    assert executables(animal) == ["speak()void", "draw(const std::string &,int,std::map<int, int>)int", "make(int,unsigned int,char *[])Animal *", "operator(const Animal &)bool", "f()int", "hid()void"]
    assert [e["visibility"] for e in animal["executables"]] == ["public"] * 5 + ["private"] and [e["staticExecutable"] for e in animal["executables"]].index(True) == 2
    assert [p["name"] for p in animal["executables"][1]["parameters"]] == ["s", "n", "m"]
    dog = got["a.b.c.Dog"]
    assert (dog["superClass"], dog["interfaces"], fields(dog), executables(dog)) == ("Animal", ["Base"], {"age": "int"}, ["bark()void"])
    assert "a.b.c.Animal.Inner" not in types(spark, declarations.cpp_types, [("r", "A.hpp", CPP)])


@pytest.mark.parametrize("text", ["}}} class A { int x; } }", "class A { int x;", "class A { void f( { } int x; }", "\"class A {", "'", "/* class A {", "{" * 300 + "}" * 300, "class A { " + "int x; " * 3000 + "}", "class", ";;;", "class A<B { int x; }", "class A { String s = \"" + "x" * 50000 + "\"; }"])
def test_files_that_do_not_compile_or_are_large(spark, text):
    for read, path in ((declarations.java_types, "A.java"), (declarations.cpp_types, "A.hpp")):
        got = types(spark, read, [("r", path, text)])
        assert set(got) <= {"A"}
        if text.startswith("}}}") or text.endswith("int x;"):
            assert set(got) == {"A"} or "}" not in text


def test_types_make_documents(spark):
    found = declarations.java_types(spark.createDataFrame([("r", "A.java", JAVA)], FILES))
    again = extraction.load_types(extraction.to_documents(found.drop("path").withColumnRenamed("pos", "tpos")))
    assert {(r["name"], r["is_abstract"]) for r in extraction.classifiers(again).collect()} == {("demo.Child", "No"), ("demo.Point", "No"), ("demo.Note", "Yes"), ("demo.Base", "No")}
    assert extraction.parents(again).count() == 1
