"""Types and members of Java and C++ source files, found by scanning brackets with DataFrame functions.

Comments and literals are blanked, a file is cut at its braces and semicolons, and the running depth of the braces says
how deep each piece lies. The innermost brace around a piece is the last one opened to its depth before it, so a window
over (file, depth) attaches members to the type whose brace that is. What a piece declares is read from its text by
patterns: types from what stands before a brace, methods from a name before a parenthesis, fields from the rest.

This reads declarations, as an extractor needs them, and checks no syntax: a file that does not compile gives what can be
read of it. A file is one row and its pieces are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structcheck.functions.arrays import let, running
from structcheck.functions.tables import dealt, written

from . import other_languages
from .python_source import first_of_name

#: The types of java.lang that a name without an import means.
JAVA_LANG = (
    "Object", "String", "Integer", "Long", "Short", "Byte", "Character", "Boolean", "Double", "Float", "Number", "Void", "Math", "Class", "Enum", "Record", "Iterable", "Comparable",
    "CharSequence", "Runnable", "Thread", "Cloneable", "AutoCloseable", "StringBuilder", "System", "Throwable", "Exception", "RuntimeException", "Error", "Override", "Deprecated",
    "IllegalArgumentException", "IllegalStateException", "UnsupportedOperationException", "IndexOutOfBoundsException", "NullPointerException", "InterruptedException",
)
PRIMITIVE = r"^(?:void|boolean|byte|short|int|long|char|float|double)$"

PARAMETER = "struct<name:string,type:string>"
FIELDS = "array<struct<name:string,type:string,visibility:string,staticField:boolean,finalField:boolean>>"
EXECUTABLES = f"array<struct<name:string,returnType:string,visibility:string,constructor:boolean,staticExecutable:boolean,abstractExecutable:boolean,parameters:array<{PARAMETER}>>>"

#: A comment, a text block, a literal. Possessive, so that long ones need no stack.
BLANKED = r"(?s:/\*.*?\*/)|//[^\n]*+|(?s:\"\"\".*?\"\"\")|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
CPP_RAW = r"R\"([^()\s\"\\]{0,16})\((?s:.*?)\)\1\"|"
CPP_DIRECTIVE = r"(?m)^[ \t]*#(?:[^\n\\]|\\\r?\n|\\)*+"
JAVA_NOTE = r"@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?"
JAVA_WORDS = r"(?:(?:public|protected|private|abstract|static|final|sealed|non-sealed|strictfp|default|synchronized|native|transient|volatile)\s+)*+"
JAVA_TYPE = rf"^\s*{JAVA_WORDS}(@interface|class|interface|enum|record)\s+(\w+)"
CPP_TYPE = r"(?s)^(?:.*[>:;\s])?\s*(class|struct)\s+(?:alignas\s*\([^()]*\)\s*|\[\[[^\]]*\]\]\s*|[A-Z][A-Z0-9_]+\s+(?=\w))*(\w+)\s*(?:final\s*)?(?::(?!:)\s*(.*))?$"
#: What stands between two commas: runs of text and brackets, nested up to four deep; a bracket without its other one is text.
PART = (
    r"(?:[^,()<>\[\]]++|<(?:[^<>]|<(?:[^<>]|<(?:[^<>]|<[^<>]*+>)*+>)*+>)*+>|\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\))*+\)"
    r"|\[[^\]]*+\]|[<>()\[\]])++"
)
#: A braced list of values behind a sign of assignment, an opening bracket or a comma.
VALUES = r"([=,({]\s*)\{[^{};]*+\}"
CPP_ACCESS = r"(?:^|[\s;])(public|protected|private)\s*:(?!:)"


def masked(content: Column, language: str) -> Column:
    """The text with comments and literals (and C++ preprocessor lines, Java annotations) as one space each, and braced lists
    of values, nested up to three deep, as a number: their braces enclose no declarations."""
    text = F.coalesce(content, F.lit(""))
    if language == "CPP":
        text = F.regexp_replace(F.regexp_replace(text, CPP_RAW + BLANKED, " "), CPP_DIRECTIVE, " ")
    else:
        text = F.regexp_replace(F.regexp_replace(text, BLANKED, " "), JAVA_NOTE, " ")
    for _ in range(3):
        text = F.regexp_replace(text, VALUES, "$1 0")
    return text


def pieces(files: DataFrame, language: str) -> DataFrame:
    """`files` (repo, path, content) cut at braces and semicolons: repo, path, pos, head, mark, depth and around.

    head is the text before the mark, depth the braces open before it, around the pos of the innermost of them (null at
    depth 0). Closing braces too many count as none.
    """
    cut = F.transform(F.regexp_extract_all(masked(F.col("content"), language), F.lit(r"([^{};]*+)([{};])"), F.lit(0)), lambda s: F.struct(F.left(s, F.length(s) - 1).alias("head"), F.right(s, F.lit(1)).alias("mark")))
    step = lambda s: F.when(s["mark"] == "{", 1).when(s["mark"] == "}", -1).otherwise(0)

    def leveled(marks: Column) -> Column:
        sums = running(F.transform(marks, step), lambda a, b: a + b)
        lows = let(sums, lambda s: F.arrays_zip(s.alias("sum"), running(F.transform(s, lambda x: F.greatest(-x, F.lit(0))), lambda a, b: F.greatest(a, b)).alias("low")))
        # What has fallen below 0 so far is added back, so that the depth never does.
        return let(F.transform(lows, lambda x: x["sum"] + x["low"]), lambda d: F.transform(marks, lambda m, i: F.struct(m["head"].alias("head"), m["mark"].alias("mark"), F.coalesce(F.when(i > 0, F.get(d, i - 1)), F.lit(0)).alias("depth"))))

    rows = files.select("repo", "path", F.posexplode(let(cut, leveled)).alias("pos", "p")).select("repo", "path", "pos", "p.*")
    inner = F.col("depth") + F.when(F.col("mark") == "{", 1).otherwise(0)
    # A brace counts for the depth that it opens, any other piece for its own.
    opened = rows.filter("mark = '{'").select("repo", "path", "pos", inner.alias("level"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("bigint").alias("depth"))
    seen = rows.withColumn("level", F.col("depth")).unionByName(opened)
    before = Window.partitionBy("repo", "path", "level").orderBy("pos", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    around = F.last(F.when(F.col("mark").isNull(), F.col("pos")), ignorenulls=True).over(before)
    return seen.withColumn("around", around).filter("mark IS NOT NULL").withColumn("around", F.when(F.col("depth") > 0, F.col("around"))).drop("level")


def _scopes(rows: DataFrame, language: str) -> DataFrame:
    """Braces of types and, in C++, namespaces: repo, path, pos, around, kind, simple, head."""
    opened = rows.filter("mark = '{'")
    if language == "JAVA":
        kind, simple = (F.regexp_extract("head", JAVA_TYPE, i) for i in (1, 2))
        return opened.select("repo", "path", "pos", "around", kind.alias("kind"), simple.alias("simple"), "head").filter("kind <> ''")
    own = F.regexp_replace("head", r"(?s)^.*(?:public|protected|private)\s*:(?!:)", "")
    clean = F.regexp_replace(own, r"template\s*<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>", " template ")
    space = F.regexp_extract(own, r"(?s)\bnamespace\b\s*(?:\[\[[^\]]*\]\]\s*)?([\w:]*)\s*$", 1)
    is_type = F.regexp_extract(clean, CPP_TYPE, 1)
    kind = F.when(own.rlike(r"(?s)\bnamespace\b[^()=]*$"), "namespace").when(own.rlike(r"(?s)\bextern\s*$"), "extern").when(clean.rlike(r"\b(?:enum|union)\b|[()=]\s*$") | (is_type == ""), None).when(clean.rlike(r"\btemplate\b"), "template").otherwise(is_type)
    simple = F.when(kind == "namespace", F.coalesce(F.nullif(F.replace(space, F.lit("::"), F.lit(".")), F.lit("")), F.lit("<anonymous>"))).when(kind == "extern", "").otherwise(F.regexp_extract(clean, CPP_TYPE, 2))
    return opened.select("repo", "path", "pos", "around", kind.alias("kind"), simple.alias("simple"), clean.alias("head")).filter(F.col("kind").isNotNull())


def _named(scopes: DataFrame, separator: str) -> DataFrame:
    """`scopes` with `name`, the names around it joined, and `outer`, the kinds around it; those within other braces are left out.

    The way up doubles with each round, so rounds are the logarithm of the deepest nesting.
    """
    now = written(scopes.withColumns({"up": F.col("around"), "name": F.col("simple"), "outer": F.array().cast("array<string>")}), "scopes")
    while not now.filter("up IS NOT NULL").isEmpty():
        above = now.select("repo", "path", F.col("pos").alias("up"), F.col("up").alias("far"), F.col("name").alias("over"), F.concat(F.array("kind"), "outer").alias("kinds"))
        joined = F.when(F.col("over") == "", F.col("name")).otherwise(F.concat("over", F.lit(separator), "name"))
        higher = now.filter("up IS NOT NULL").join(above, ["repo", "path", "up"]).select(*[F.col(c) for c in scopes.columns], F.col("far").alias("up"), joined.alias("name"), F.concat("outer", "kinds").alias("outer"))
        now = written(now.filter("up IS NULL").unionByName(higher), "scopes")
    return now.drop("up")


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _without_angles(text: Column) -> Column:
    """The text without what stands in angle brackets, nested up to four deep."""
    for _ in range(4):
        text = F.regexp_replace(text, r"\s*<[^<>]*>", "")
    return text


def _parts(text: Column) -> Column:
    """The parts of a list, cut at the commas outside of all brackets."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(PART), F.lit(0)), lambda p: _squeezed(p)), lambda p: p != "")


def _before(text: Column, mark: str) -> Column:
    return F.trim(F.substring_index(text, mark, 1))


def _has(text: Column, word: str) -> Column:
    return text.rlike(rf"(?:^|\s){word}(?:\s|$)")


def _members(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """The pieces right within a type of `scopes` that open none: repo, path, pos, head, mark, of (the type's pos), kind, simple.
    Those before the first semicolon of their type have `first`."""
    inside = rows.filter("around IS NOT NULL").select("repo", "path", "pos", "mark", "head", F.col("around").alias("of"))
    before = Window.partitionBy("repo", "path", "of").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("first", F.coalesce(F.count_if(F.col("mark") == ";").over(before), F.lit(0)) == 0)
    types = scopes.select("repo", "path", F.col("pos").alias("of"), "kind", "simple")
    return inside.join(types, ["repo", "path", "of"]).join(scopes.select("repo", "path", "pos"), ["repo", "path", "pos"], "left_anti")


def _java_members(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """repo, path, of and m: fields (with a null return type) and executables, types as they are written."""
    of = _members(rows, scopes).withColumn("h", _squeezed(_without_angles(F.col("head"))))
    h, kind = F.col("h"), F.col("kind")
    constant = (kind == "enum") & F.col("first")
    open_type = kind.isin("interface", "@interface")
    words = F.regexp_extract(h, rf"^({JAVA_WORDS})", 1)
    decl = F.substr(h, F.length(words) + 1)
    call = r"^(?:([\w.]+(?:\s*\[\s*\])*)\s+)?(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)((?:\s*\[\s*\])*)[^()]*"
    executable = ~F.col("h").rlike(r"^[^(]*=") & decl.rlike(call + "$|" + call + r"\bdefault\b")
    compact = (kind == "record") & (F.col("mark") == "{") & (decl == F.col("simple"))
    visibility = F.when(words.contains("public") | (open_type & ~words.contains("private")), "public").when(words.contains("protected"), "protected").when(words.contains("private"), "private").otherwise("package-private")
    name, result = F.regexp_extract(decl, call, 2), F.regexp_extract(decl, call, 1)
    constructor = (result == "") & (name == F.col("simple"))

    def parameter(p: Column) -> Column:
        t = F.regexp_replace(p, r"^(?:final\s+)+", "")
        return F.struct(F.regexp_extract(t, r"(\w+)(?:\s*\[\s*\])*$", 1).alias("name"), F.concat(F.regexp_replace(F.regexp_replace(t, r"\s*\w+((?:\s*\[\s*\])*)$", "$1"), r"\s+", "")).alias("type"))

    given = F.filter(F.transform(F.split(F.regexp_extract(decl, call, 3), ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"\bthis$"))
    none = F.array().cast(f"array<{PARAMETER}>")
    method = F.struct(
        F.when(compact, "<compact>").when(constructor, "<init>").otherwise(name).alias("name"), F.when(~(constructor | compact), F.regexp_replace(F.concat(result, F.regexp_extract(decl, call, 4)), r"\s+", "")).alias("type"), visibility.alias("visibility"),
        _has(words, "static").alias("static"), F.lit(False).alias("final"), F.lit(True).alias("executable"), (constructor | compact).alias("constructor"),
        (_has(words, "abstract") | (open_type & (F.col("mark") == ";") & ~_has(words, "(?:static|default|private)"))).alias("abstract"), F.when(compact, none).otherwise(F.transform(given, parameter)).alias("parameters"),
    )
    listed = _parts(F.regexp_replace(decl, r"=\s*$", ""))
    first = _before(F.get(listed, F.lit(0)), "=")
    kind_of = F.regexp_replace(F.regexp_extract(first, r"^([\w.]+(?:\s*\[\s*\])*)\s+\w+((?:\s*\[\s*\])*)$", 1), r"\s+", "")

    def field(part: Column, i: Column) -> Column:
        own = _before(part, "=")
        dims = F.regexp_replace(F.regexp_extract(own, r"((?:\s*\[\s*\])*)$", 1), r"\s+", "")
        return F.struct(
            F.regexp_extract(own, r"(\w+)(?:\s*\[\s*\])*$", 1).alias("name"), F.concat(kind_of, dims).alias("type"), visibility.alias("visibility"), (_has(words, "static") | open_type).alias("static"),
            (_has(words, "final") | open_type).alias("final"), F.lit(False).alias("executable"), F.lit(False).alias("constructor"), F.lit(False).alias("abstract"), none.alias("parameters"),
        )

    def one_of(part: Column) -> Column:
        return F.struct(
            F.regexp_extract(part, r"^(\w+)", 1).alias("name"), F.lit("\u0001").alias("type"), F.lit("public").alias("visibility"), F.lit(True).alias("static"), F.lit(True).alias("final"),
            F.lit(False).alias("executable"), F.lit(False).alias("constructor"), F.lit(False).alias("abstract"), none.alias("parameters"),
        )

    found = F.when(constant, F.transform(_parts(h), one_of)).when(F.col("mark") == "}", F.array()).when(executable | compact, F.array(method)).when(kind_of != "", F.transform(listed, field)).otherwise(F.array())
    each = of.select("repo", "path", "of", "pos", F.posexplode(found).alias("i", "m")).filter("m.name <> ''")
    # The components of a record's head are its fields, and methods without parameters.
    heads = scopes.filter("kind = 'record'").select("repo", "path", F.col("pos").alias("of"), F.explode(F.transform(F.split(F.regexp_extract(_squeezed(_without_angles(F.col("head"))), r"\((.*)\)", 1), ","), lambda p: parameter(F.trim(p)))).alias("p")).filter("p.name <> ''")
    made = lambda private, executable: F.struct(F.col("p.name").alias("name"), F.col("p.type").alias("type"), F.lit("private" if private else "public").alias("visibility"), F.lit(False).alias("static"), F.lit(private).alias("final"), F.lit(executable).alias("executable"), F.lit(False).alias("constructor"), F.lit(False).alias("abstract"), none.alias("parameters"))
    parts = heads.select("repo", "path", "of", F.explode(F.array(made(True, False), made(False, True))).alias("m"))
    declared = each.filter("m.executable AND size(m.parameters) = 0").select("repo", "path", "of", F.col("m.name").alias("n")).distinct()
    parts = parts.join(declared, (parts["repo"] == declared["repo"]) & (parts["path"] == declared["path"]) & (parts["of"] == declared["of"]) & (F.col("m.name") == F.col("n")) & F.col("m.executable"), "left_anti")
    return each.select("repo", "path", "of", "m").unionByName(parts)


def java_types(files: DataFrame, nested: bool = False) -> DataFrame:
    """The types of Java files (repo, path, content): repo, path, pos and the fields of an extraction's type, by name and path.

    Types within others are left out, as by the model that is extracted, unless `nested` asks for them (``Outer$Inner``);
    types within methods always are. A type is named after the file's package; a name in a declaration means an import,
    a type of the file's package, a common one of java.lang, or stays as it is; type arguments are dropped. Fields come by name,
    methods by signature, then constructors, a class without one has one without parameters. What interfaces,
    enums and records imply is added: public members, abstract methods, constants, final fields and their accessors. A null
    content has no types.
    """
    files = dealt(files.select("repo", "path", "content"), "repo", "path")
    head = files.select("repo", "path", masked(F.col("content"), "JAVA").alias("t"))
    head = head.select("repo", "path", F.regexp_extract("t", r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"), F.regexp_extract_all("t", F.lit(r"\bimport\s+([\w.]+)\s*;"), F.lit(1)).alias("imports"))
    rows = written(pieces(files, "JAVA"), "pieces")
    scopes = _named(_scopes(rows, "JAVA"), "$")
    members = _java_members(rows, scopes).groupBy("repo", "path", F.col("of").alias("pos")).agg(F.collect_list("m").alias("ms"))
    full = lambda name: F.when(F.col("package") == "", name).otherwise(F.concat("package", F.lit("."), name))
    types = scopes.join(head, ["repo", "path"]).join(members, ["repo", "path", "pos"], "left")
    h = _squeezed(_without_angles(F.regexp_replace("head", r"\((?:[^()]|\([^()]*\))*\)", "")))
    clause = lambda word: F.filter(F.transform(F.split(F.regexp_extract(h, rf"\b{word}\s+(.*?)\s*(?:\b(?:extends|implements|permits)\b.*)?$", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    interface = F.col("kind").isin("interface", "@interface")
    types = types.select(
        "repo", "path", "pos", "package", "imports", "outer", "simple", F.regexp_extract("head", rf"^\s*({JAVA_WORDS})", 1).alias("words"), other_languages.java_kind(F.col("kind") == "@interface", F.col("kind") == "enum", F.col("kind") == "record", F.col("kind") == "interface").alias("kind"),
        full(F.col("name")).alias("qualifiedName"), F.when(~interface, F.get(clause("extends"), F.lit(0))).alias("above"), F.when(interface, clause("extends")).otherwise(clause("implements")).alias("over"), F.coalesce("ms", F.array()).alias("ms"),
    )
    types = written(types if nested else types.filter(F.size("outer") == 0), "types")
    # Names of declarations that mean a type of the same package.
    said = F.array_distinct(F.concat(F.coalesce(F.array("above"), F.array()), "over", F.transform("ms", lambda m: m["type"]), F.flatten(F.transform("ms", lambda m: F.transform(m["parameters"], lambda p: p["type"])))))
    asked = types.select("repo", "path", "pos", "package", F.explode(F.array_distinct(F.transform(said, lambda t: F.regexp_extract(t, r"^(\w+)", 1)))).alias("simple"))
    own = types.filter(F.size("outer") == 0).select("repo", "package", "simple").distinct()
    near = asked.filter("simple <> ''").join(own, ["repo", "package", "simple"], "left_semi").groupBy("repo", "path", "pos").agg(F.collect_set("simple").alias("near"))
    types = types.join(near, ["repo", "path", "pos"], "left").withColumn("near", F.coalesce("near", F.array()))

    def resolved(t: Column) -> Column:
        base, dims = F.regexp_replace(t, r"(?:\[\]|\.\.\.)", ""), F.repeat(F.lit("[]"), F.size(F.split(t, r"\[\]|\.\.\.")) - 1)
        hit = F.get(F.filter("imports", lambda i: F.substring_index(i, ".", -1) == base), F.lit(0))
        of = F.when(base.rlike(PRIMITIVE) | base.contains("."), base).when(hit.isNotNull(), hit).when(F.array_contains("near", base), full(base)).when(base.isin(*JAVA_LANG), F.concat(F.lit("java.lang."), base)).otherwise(base)
        return F.when(t == "\u0001", F.col("qualifiedName")).otherwise(F.concat(of, dims))

    typed = F.transform("ms", lambda m: m.withField("type", resolved(m["type"])).withField("parameters", F.transform(m["parameters"], lambda p: F.struct(p["name"].alias("name"), resolved(p["type"]).alias("type")))))
    types = types.withColumn("ms", typed)
    signature = lambda m: F.concat(m["name"], F.lit("("), F.array_join(F.transform(m["parameters"], lambda p: p["type"]), ","), F.lit(")"))
    executable = lambda m: F.struct(signature(m).alias("by"), F.struct(m["name"].alias("name"), m["type"].alias("returnType"), m["visibility"].alias("visibility"), m["constructor"].alias("constructor"), m["static"].alias("staticExecutable"), m["abstract"].alias("abstractExecutable"), m["parameters"].alias("parameters")).alias("m"))
    field = lambda m: F.struct(m["name"].alias("name"), m["type"].alias("type"), m["visibility"].alias("visibility"), m["static"].alias("staticField"), m["final"].alias("finalField"))
    visibility = F.when(F.col("words").contains("public"), "public").when(F.col("words").contains("protected"), "protected").when(F.col("words").contains("private") | (F.col("kind") == "enum"), "private").otherwise("package-private")
    components = F.transform(F.filter("ms", lambda m: ~m["executable"] & ~m["static"]), lambda m: F.struct(m["name"].alias("name"), m["type"].alias("type")))
    implied = F.struct(F.lit("<init>").alias("name"), F.lit(None).cast("string").alias("returnType"), visibility.alias("visibility"), F.lit(True).alias("constructor"), F.lit(False).alias("staticExecutable"), F.lit(False).alias("abstractExecutable"), F.when(F.col("kind") == "record", components).otherwise(F.array()).cast(f"array<{PARAMETER}>").alias("parameters"))
    # The compact constructor of a record takes its components.
    canonical = lambda m: F.when(m["name"] == "<compact>", m.withField("name", F.lit("<init>")).withField("parameters", components)).otherwise(m)
    methods = F.transform(F.array_sort(F.transform(F.filter("ms", lambda m: m["executable"] & ~m["constructor"]), executable)), lambda x: x["m"])
    written_out = F.transform(F.array_sort(F.transform(F.transform(F.filter("ms", lambda m: m["constructor"]), canonical), executable)), lambda x: x["m"])
    constructors = F.when(F.col("kind").isin("interface", "annotation"), F.array()).when(F.size(written_out) == 0, F.array(implied)).otherwise(written_out)
    above = resolved(F.col("above"))
    return types.select(
        "repo", "path", "pos", "qualifiedName", F.col("simple").alias("simpleName"), "kind", F.when(above != "java.lang.Object", above).alias("superClass"), F.array_sort(F.transform("over", resolved)).alias("interfaces"),
        F.array_sort(F.transform(F.filter("ms", lambda m: ~m["executable"]), field)).cast(FIELDS).alias("fields"), F.concat(methods.cast(EXECUTABLES), constructors.cast(EXECUTABLES)).alias("executables"),
        (_has(F.col("words"), "abstract") | F.col("kind").isin("interface", "annotation")).alias("abstractType"), (_has(F.col("words"), "final") | F.col("kind").isin("enum", "record")).alias("finalType"), F.col("path").alias("sourceFile"),
    ).orderBy("repo", "qualifiedName", "sourceFile")


def cpp_types(files: DataFrame, nested: bool = False) -> DataFrame:
    """The classes and structs of C++ files (repo, path, content): repo, path, pos and the fields of an extraction's type.

    Only definitions with a name count, of one name in a repository the first by path and place; templates are left out, and
    types within others unless `nested` asks for them. Namespaces and names are joined by dots. The first base is the
    superclass, by its last name. Fields that are private are left out; members of a struct are public by default.
    Methods are those with a return type: no constructors, destructors, conversions or templates; the name of an operator is
    ``operator``; one that ends in ``= 0`` is abstract, as is its type. A null content has no types.
    """
    files = dealt(files.select("repo", "path", "content"), "repo", "path")
    rows = written(pieces(files, "CPP"), "pieces")
    scopes = _named(_scopes(rows, "CPP"), ".")
    types = scopes.filter(F.col("kind").isin("class", "struct"))
    inner = F.exists("outer", lambda k: k.isin("class", "struct", "template"))
    types = types if nested else types.filter(~inner)
    of = _members(rows, scopes).filter(F.col("kind").isin("class", "struct"))
    label = F.regexp_extract_all("head", F.lit(CPP_ACCESS), F.lit(1))
    # Pieces that open a type or end one carry labels as well, so labels are looked up before those are left out.
    labels = rows.filter("around IS NOT NULL").select("repo", "path", "pos", F.last(F.get(label, F.size(label) - 1), ignorenulls=True).over(Window.partitionBy("repo", "path", "around").orderBy("pos")).alias("access"))
    of = of.join(labels, ["repo", "path", "pos"]).withColumn("access", F.coalesce("access", F.when(F.col("kind") == "struct", "public").otherwise("private")))
    hidden = F.col("d")
    for _ in range(4):
        hidden = F.regexp_replace(hidden, r"<([^<>()]*)\(([^<>()]*)\)([^<>]*)>", "<$1\u0006$2\u0007$3>")
    d = _squeezed(F.regexp_replace("head", r"(?s)^.*?(?:public|protected|private)\s*:(?!:)(?!.*(?:public|protected|private)\s*:(?!:))", ""))
    of = of.withColumn("d", F.regexp_replace(d, r"\[\[[^\]]*\]\]", "")).withColumn("d", hidden)
    call = r"^(.*?)\s*(\boperator\s*(?:\(\s*\)|\[\s*\]|[^\s\w(]+|new|delete)|~?\w+)\s*\(((?:[^()]|\([^()]*\))*)\)([^()]*(?:\([^()]*\)[^()]*)*)$"
    pointer = r"\(\s*\*\s*(\w+)\s*\)\s*\("
    opened = lambda t: F.translate(t, "\u0006\u0007", "()")
    spelled = lambda t: F.trim(F.regexp_replace(F.regexp_replace(_squeezed(opened(t)), r"\s*([*&]+)\s*", " $1"), r"([*&]) (?=[*&])", "$1"))
    words = r"\b(?:virtual|static|inline|explicit|mutable|friend|typename|constexpr|extern|thread_local|register)\b"
    prefix, name, after = F.regexp_extract("d", call, 1), F.regexp_extract("d", call, 2), F.regexp_extract("d", call, 4)
    result = F.trim(F.regexp_replace(prefix, words, ""))
    skipped = F.col("d").rlike(r"^(?:template|friend|using|typedef|static_assert|enum|union|class|struct|namespace|public|private|protected)\b") & ~F.col("d").rlike(r"^(?:class|struct|enum)\s+\w+\s*[*&\w]")
    # Of an inline constructor only what stands before its list of initial values.
    method = F.col("d").rlike(call) & ~F.col("d").rlike(pointer) & ~F.col("d").rlike(r"^[^(]*=") | F.col("d").rlike(r"\boperator\b")

    def parameter(p: Column) -> Column:
        t = _before(p, "=")
        named = t.rlike(r"(?s)^.*[\s*&>\]]\w+(?:\[[^\]]*\])*$") & ~t.rlike(r"(?:^|[\s:])(?:int|char|long|short|double|float|bool|unsigned|signed|const|void|auto)$") & ~t.rlike(r"^(?:const|unsigned|signed|struct|class|enum)\s+[\w:]+$") & ~t.rlike(pointer)
        split = r"(?s)^(.*[\s*&>\]])(\w+)((?:\[[^\]]*\])*)$"
        return F.struct(F.when(named, F.regexp_extract(t, split, 2)).otherwise("").alias("name"), spelled(F.when(named, F.concat(F.regexp_extract(t, split, 1), F.regexp_extract(t, split, 3))).otherwise(t)).alias("type"))

    returned = F.when(after.contains("->"), F.regexp_extract(after, r"->\s*([^={]*)", 1)).otherwise(result)
    executable = F.struct(
        F.when(name.startswith("operator"), "operator").otherwise(name).alias("name"), spelled(returned).alias("returnType"), F.col("access").alias("visibility"), F.lit(False).alias("constructor"), prefix.rlike(r"\bstatic\b").alias("staticExecutable"),
        after.rlike(r"=\s*0\s*$").alias("abstractExecutable"), F.transform(F.filter(_parts(F.regexp_extract("d", call, 3)), lambda p: p != "void"), parameter).alias("parameters"),
    )
    listed = _parts(F.regexp_replace("d", r"\s*=\s*$", ""))
    split = r"(?s)^(.*[\s*&>])(\w+)\s*((?:\[[^\]]*\]\s*)*)(?::\s*\d+)?$"
    first = _before(F.get(listed, F.lit(0)), "=")
    base = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(first, split, 1), r"\bconstexpr\b", "const"), words, ""))
    plain = F.regexp_replace(base, r"[\s*&]+$", "")

    def field(part: Column, i: Column) -> Column:
        own = _before(part, "=")
        later = F.concat(plain, F.lit(" "), F.regexp_extract(own, r"^([*&\s]*)", 1))
        dims = F.regexp_extract(own, r"((?:\[[^\]]*\]\s*)*)(?::\s*\d+)?$", 1)
        shown = F.when(F.col("d").rlike(pointer), opened(F.regexp_replace(first, r"\(\s*\*\s*\w+\s*\)\s*", "(*)"))).otherwise(F.concat(spelled(F.when(i == 0, base).otherwise(later)), F.when(dims != "", F.concat(F.lit(""), F.trim(dims))).otherwise("")))
        called = F.when(F.col("d").rlike(pointer), F.regexp_extract("d", pointer, 1)).otherwise(F.regexp_extract(own, r"(\w+)\s*(?:\[[^\]]*\]\s*)*(?::\s*\d+)?$", 1))
        return F.struct(called.alias("name"), shown.alias("type"), F.col("access").alias("visibility"), F.lit(False).alias("staticField"), F.lit(False).alias("finalField"))

    shown = (F.col("mark") != "}") & (F.col("d") != "") & ~skipped
    is_method = shown & method & (result != "") & ~name.startswith("~") & ~result.endswith("operator")
    is_field = shown & ~method & (F.col("access") != "private") & ((base != "") | F.col("d").rlike(pointer))
    of = of.select("repo", "path", "of", "pos", F.when(is_method, executable).alias("e"), F.when(is_field, F.transform(F.when(F.col("d").rlike(pointer), F.slice(listed, 1, 1)).otherwise(listed), field)).alias("f"))
    of = of.filter("e IS NOT NULL OR f IS NOT NULL").groupBy("repo", "path", F.col("of").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "e", "f"))).alias("ms"))
    found = types.join(of, ["repo", "path", "pos"], "left").withColumn("ms", F.coalesce("ms", F.array()))
    bases = F.transform(_parts(F.regexp_extract("head", CPP_TYPE, 3)), lambda b: F.substring_index(F.trim(F.regexp_replace(_without_angles(b), r"\b(?:public|protected|private|virtual)\b", "")), "::", -1))
    found = found.withColumn("bases", bases)
    executables = F.filter(F.transform("ms", lambda m: m["e"]), lambda e: e.isNotNull())
    out = found.select(
        "repo", "path", "pos", F.col("name").alias("qualifiedName"), F.col("simple").alias("simpleName"), F.lit("class").alias("kind"), F.get("bases", F.lit(0)).alias("superClass"), F.coalesce(F.slice("bases", 2, F.greatest(F.size("bases"), F.lit(1))), F.array()).alias("interfaces"),
        F.flatten(F.filter(F.transform("ms", lambda m: m["f"]), lambda f: f.isNotNull())).cast(FIELDS).alias("fields"), executables.cast(EXECUTABLES).alias("executables"), F.exists(executables, lambda e: e["abstractExecutable"]).alias("abstractType"), F.lit(False).alias("finalType"), F.col("path").alias("sourceFile"),
    )
    return first_of_name(out)
