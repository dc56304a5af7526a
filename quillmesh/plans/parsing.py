"""Queries that parse sources written from the parts table: each file's text is a template in which {k} is the part's key and {s} its size.

The SQL beside a query states the rows that the template must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.docs import doc_details
from quillmesh.plans.registry import query
from quillmesh.sources import bindings as b
from quillmesh.sources import ingest


def _filled(text: str):
    out = F.lit(text)
    for mark, column in (("{k}", "p_partkey"), ("{s}", "p_size")):
        out = F.replace(out, F.lit(mark), F.col(column).cast("string"))
    return out


FILES_PER_TASK, LEAST_PER_TASK = 4096, 512


def dealt(parts: DataFrame) -> DataFrame:
    """Parts in tasks of so many: a key and a size take few bytes and become a file to parse, so the size of the input is no measure of the work."""
    count = parts.count()
    n = max(-(-count // FILES_PER_TASK), min(parts.sparkSession.sparkContext.defaultParallelism, -(-count // LEAST_PER_TASK)))
    return parts.repartition(n, "p_partkey") if n > 1 else parts


def written(spark: SparkSession, sf_dir: str, template: str, ending: str, stem: str = "src/f{k}") -> DataFrame:
    """A file for each part: file_path, content, file_size."""
    rows = dealt(b.table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(_filled(stem + ending).alias("file_path"), _filled(template).alias("content"))
    return rows.withColumn("file_size", F.octet_length("content").cast("long"))


def parsed(spark: SparkSession, sf_dir: str, template: str, ending: str, relation: str, stem: str = "src/f{k}") -> DataFrame:
    records = ingest.parse_files(written(spark, sf_dir, template, ending, stem), only=(relation,))
    return records.filter(F.col("relation") == relation).select(F.from_json("payload", ingest.RELATIONS[relation]).alias("r")).select("r.*")


def _sql_value(v: object) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    quoted = "'" + v.replace("'", "''") + "'"
    return f"replace(replace({quoted}, '{{k}}', CAST(p_partkey AS VARCHAR)), '{{s}}', CAST(p_size AS VARCHAR))"


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL that gives these rows for every part."""
    names = columns.split()
    return " UNION ALL ".join("SELECT p_partkey, " + ", ".join(f"{_sql_value(v)} AS {n}" for n, v in zip(names, r, strict=True)) + " FROM part" for r in rows)


def source_query(name: str, ending: str, relation: str, columns: str, template: str, rows: list[tuple], where: str = "true", stem: str = "src/f{k}", about: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.regexp_extract("referencing_file" if relation == "refs" else "file_path", r"f(\d+)\.", 1).cast("long").alias("p_partkey")
        return parsed(spark, sf_dir, template, ending, relation, stem).filter(where).select(key, *columns.split())

    run.__doc__ = about
    query(name, expected(columns, rows))(run)


source_query("s6a_functions", ".ts", "symbols", "name kind line_start is_exported is_async is_generator return_type", """export function alpha{k}(x: number): number { return x; }
const beta{k} = (y: string) => { return y; };
function* gamma{k}() { yield 1; }
async function delta{k}() { await 1; }
""", [("alpha{k}", "function", 1, True, False, False, "number"), ("beta{k}", "function", 2, False, False, False, None), ("gamma{k}", "function", 3, False, False, True, None), ("delta{k}", "function", 4, False, True, False, None)])  # fmt: skip

source_query("s6b_nested_functions", ".ts", "symbols", "local_name parent_function nesting_depth line_start line_end", """function outer{k}() {
  function inner{k}() {
    const deep{k} = (a: number) => {
      const b = a;
      return b;
    };
    return deep{k}(1);
  }
  const tiny{k} = () => 1;
  return inner{k}();
}
""", [("outer{k}", None, 0, 1, 11), ("inner{k}", "outer{k}", 1, 2, 8), ("deep{k}", "outer{k}.inner{k}", 2, 3, 6)])  # fmt: skip

source_query("s6c_private", ".ts", "symbols", "name is_private", """function _hid{k}() { return 1; }
function seen{k}() { return 2; }
class Box{k} {
  private a{k}(): void { return; }
  #b{k}(): void { return; }
  c{k}(): void { return; }
}
""", [("_hid{k}", True), ("seen{k}", False), ("Box{k}", False), ("a{k}", True), ("#b{k}", True), ("c{k}", False)])  # fmt: skip

source_query("s6d_callbacks", ".ts", "symbols", "name kind callback_context", """describe('suite {k}', () => {
  it('case {s}', () => { run{k}(); });
});
button.addEventListener('click', (e) => { go{k}(e); });
other.forEach((e) => { go{k}(e); });
""", [("suite_{k}", "callback", "describe"), ("case_{s}", "callback", "it"), ("addEventListener_callback_4", "callback", "addEventListener:click")])  # fmt: skip

_CLASS = """export abstract class Car{k} extends Base{s}<Car> implements Drive, Stop {
  static wheels{k}: number = 4;
  protected speed: number = 0;
  constructor(public id: number) { super(); }
  async go{k}(far: boolean): Promise<void> { return; }
  get label(): string { return 'x'; }
}
"""
source_query("s6e_classes", ".ts", "symbols", "name kind parent_class return_type is_abstract is_static is_async", _CLASS, [
    ("Car{k}", "class", None, None, True, False, False), ("wheels{k}", "property", "Car{k}", "number", False, True, False), ("speed", "property", "Car{k}", "number", False, False, False),
    ("go{k}", "method", "Car{k}", "Promise<void>", False, False, True), ("label", "method", "Car{k}", "string", False, False, False),
])

source_query("s6f_interfaces", ".ts", "symbols", "name kind signature is_exported", """export interface Shape{k}<T> extends Base{s}, Other {
  area: number;
  name?: string;
  scale(by: number): Shape{k}<T>;
}
""", [("Shape{k}", "interface", "export interface Shape{k}<T> extends Base{s}, Other", True)])  # fmt: skip

source_query("s6g_aliases_and_variables", ".ts", "symbols", "name kind return_type is_exported", """export type Id{k} = string | number;
type Local{k} = Id{k}[];
export const LIMIT{k}: number = {s};
let other{k} = 'x', more{k} = 2;
const fn{k} = () => 1;
""", [("Id{k}", "type", None, True), ("Local{k}", "type", None, False), ("LIMIT{k}", "variable", "number", True), ("other{k}", "variable", None, False), ("more{k}", "variable", None, False), ("fn{k}", "function", None, False)])  # fmt: skip

_IMPORTS = """import def{k}, { one as two, three } from './m{s}';
import * as ns from 'pkg{k}';
import type { T{k} } from '../t';
import './side{k}';
"""


@query("s6h_imports", expected("import_source is_type_only names", [("./m{s}", False, "def{k}:default,one as two,three"), ("pkg{k}", False, "* as ns"), ("../t", True, "T{k}"), ("./side{k}", False, "")]))
def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default, namespace, renamed and type-only imports, and one for its effects."""
    rows = parsed(spark, sf_dir, _IMPORTS, ".ts", "imports")
    one = lambda s: F.concat(s["name"], F.when(s["alias"].isNotNull(), F.concat(F.lit(" as "), s["alias"])).otherwise(""), F.when(s["is_default"], ":default").otherwise(""))
    return rows.select(F.regexp_extract("file_path", r"f(\d+)\.", 1).cast("long").alias("p_partkey"), "import_source", "is_type_only", F.array_join(F.transform("specifiers", one), ",").alias("names"))


source_query("s6i_exports", ".ts", "exports", "export_name is_default is_re_export re_export_source", """const a = 1, b = 2;
export { a as x{k}, b };
export * from './all{k}';
export { c as d{k} } from './one';
export default function main{k}() { return 1; }
""", [("x{k}", False, False, None), ("b", False, False, None), ("*", False, True, "./all{k}"), ("d{k}", False, True, "./one"), ("main{k}", True, False, None)])  # fmt: skip

source_query("s6j_references", ".ts", "refs", "symbol_name referencing_symbol_name line_number reference_kind", """import { used{k} } from './m';
function call{k}() {
  const obj = new Thing{k}();
  return used{k}(obj.field{k});
}
""", [("used{k}", None, 1, "import"), ("obj", "call{k}", 3, "write"), ("Thing{k}", "call{k}", 3, "call"), ("used{k}", "call{k}", 4, "call"), ("obj", "call{k}", 4, "read"), ("field{k}", "call{k}", 4, "read")])  # fmt: skip

source_query("s6k_calls", ".ts", "calls", "caller_name callee_name call_count is_async is_conditional", """async function caller{k}() {
  await svc.load{k}(1);
  if (ok) { save{k}<number>(2); }
  load{k}(3);
  return load{k}(4);
}
""", [("caller{k}", "load{k}", 3, True, False), ("caller{k}", "save{k}", 1, False, True)])  # fmt: skip

source_query("s6l_anonymous_callers", ".ts", "calls", "caller_name callee_name call_count", """const handler{k} = () => { hit{k}(); };
list.map(() => { lost{k}(); });
function named{k}() { list.map(() => { inner{k}(); }); }
""", [("handler{k}", "hit{k}", 1), ("named{k}", "map", 1), ("named{k}", "inner{k}", 1)])  # fmt: skip

source_query("s6m_type_relations", ".ts", "type_rels", "source_name target_name target_name_base relationship_kind", """class A{k} extends B{s}<X> implements C, D<Y> { }
interface E{k} extends F{s}<Z>, G { }
""", [("A{k}", "B{s}<X>", "B{s}", "extends"), ("A{k}", "C", "C", "implements"), ("A{k}", "D<Y>", "D", "implements"), ("E{k}", "F{s}<Z>", "F{s}", "extends"), ("E{k}", "G", "G", "extends")])  # fmt: skip

source_query("s6n_signatures", ".ts", "symbols", "name signature return_type", "export async function sig{k}<T extends object>(a: number, b?: string, c = {s}, ...d: T[]): Promise<T> { return x; }\n", [
    ("sig{k}", "export async function sig{k}<T extends object>(a: number, b?: string, c = {s}, ...d: T[]): Promise<T>", "Promise<T>"),
])


def _details(spark: SparkSession, sf_dir: str, template: str, ending: str) -> DataFrame:
    rows = parsed(spark, sf_dir, template, ending, "symbols").select(F.regexp_extract("file_path", r"f(\d+)\.", 1).cast("long").alias("p_partkey"), "local_name", doc_details()("doc", "language").alias("d"))
    joined = lambda c: F.array_join(c, "|")
    params = F.transform("d.params", lambda p: F.concat_ws("/", p["name"], F.coalesce(p["type"], F.lit("-")), p["description"]))
    return rows.select("p_partkey", "local_name", "d.description", joined(params).alias("params"), "d.returns", "d.deprecated", joined(F.col("d.throws")).alias("throws"), joined(F.col("d.examples")).alias("examples"), joined(F.transform("d.tags", lambda t: F.concat_ws("/", t["name"], t["text"]))).alias("tags"))


_DOC_COLUMNS = "local_name description params returns deprecated throws examples tags"


@query("s6o_block_comments", expected(_DOC_COLUMNS, [("add{k}", "Adds number {k}.", "a/-/the first {s}|b/string/the second", "the sum {k}", "use other{k}", "RangeError: when {s}", "add(1, {k})", "since/1.{s}"), ("bare{k}", None, "", None, None, "", "", "")]))
def block_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _details(spark, sf_dir, """/**
 * Adds number {k}.
 * @param a the first {s}
 * @param {string} b the second
 * @returns the sum {k}
 * @throws {RangeError} when {s}
 * @deprecated use other{k}
 * @example
 * add(1, {k})
 * @since 1.{s}
 */
export function add{k}(a: number, b: string) { return 1; }
/** */
function bare{k}() { return 1; }
""", ".ts")  # fmt: skip


source_query("s7a_python_functions", ".py", "symbols", "name kind parent_class line_start", """import functools

@functools.cache
def top{k}(a):
    def inner{k}():
        return 1
    return inner{k}()

if a:
    def hidden{k}():
        return 2

class Box{k}:
    def method{k}(self):
        return 3
""", [("top{k}", "function", None, 4), ("Box{k}", "class", None, 13), ("method{k}", "method", "Box{k}", 14)])  # fmt: skip

source_query("s7b_python_methods", ".py", "symbols", "name kind is_private is_static is_async", """class Box{k}:
    def __init__(self, n):
        self.n = n
    def run{k}(self):
        return 1
    def _own{k}(self):
        return 2
    @staticmethod
    def fixed{k}():
        return 3
    async def later{k}(self):
        return 4
""", [("Box{k}", "class", False, False, False), ("__init__", "constructor", False, False, False), ("run{k}", "method", False, False, False), ("_own{k}", "method", True, False, False), ("fixed{k}", "method", False, True, False), ("later{k}", "method", False, False, True)])  # fmt: skip


@query("s7c_python_parameters", expected("params", [("a:-:0:0:0|b:int:0:0:0|c:-:1:1:0|d:str:1:1:0|*rest:-:0:0:1|key:-:0:0:0|other:int:1:1:0|**more:-:0:0:1",)]))
def python_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, type, optional, default, rest."""
    rows = parsed(spark, sf_dir, 'def many{k}(a, b: int, c={s}, d: str = "x", *rest, key, other: int = 1, **more):\n    return a\n', ".py", "symbols")
    flag = lambda c: c.cast("int").cast("string")
    one = lambda p: F.concat_ws(":", p["name"], F.coalesce(p["type"], F.lit("-")), flag(p["optional"]), flag(p["has_default"]), flag(p["rest"]))
    return rows.select(F.regexp_extract("file_path", r"f(\d+)\.", 1).cast("long").alias("p_partkey"), F.array_join(F.transform("params", one), "|").alias("params"))


@query("s7d_docstrings", expected(_DOC_COLUMNS, [("doc{k}", "Adds numbers {k}.", "a/int/the first {s}|b/-/the second goes on", "int: the sum {k}", None, "ValueError: when {s}", ">>> doc{k}(1, 2)", ""), ("numpy{k}", "Sums.", "x/int/the x", "int all {s}", None, "", "", ""), ("none{k}", None, "", None, None, "", "", "")]))
def docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _details(spark, sf_dir, '''def doc{k}(a, b):
    """Adds numbers {k}.

    Args:
        a (int): the first {s}
        b: the second
            goes on

    Returns:
        int: the sum {k}

    Raises:
        ValueError: when {s}

    Examples:
        >>> doc{k}(1, 2)
    """
    return a

def numpy{k}(x):
    """Sums.

    Parameters
    ----------
    x : int
        the x

    Returns
    -------
    int
        all {s}
    """
    return x

def none{k}():
    return 1
''', ".py")  # fmt: skip


source_query("s7e_python_generators", ".py", "symbols", "name is_generator", """def gen{k}():
    yield {s}

def outer{k}():
    def inner():
        yield 1
    return inner

def none{k}():
    return 1
""", [("gen{k}", True), ("outer{k}", True), ("none{k}", False)])  # fmt: skip

source_query("s7f_python_bases", ".py", "type_rels", "source_name target_name target_name_base relationship_kind", """class A{k}(Base{s}, Mixin, Generic[T]):
    pass

class B{k}:
    pass
""", [("A{k}", "Base{s}", "Base{s}", "extends"), ("A{k}", "Mixin", "Mixin", "mixin"), ("A{k}", "Generic[T]", "Generic", "mixin")])  # fmt: skip

source_query("s7g_python_variables", ".py", "symbols", "name kind parent_class return_type is_private is_static", """LIMIT{k}: int = {s}
_own{k} = 1
both{k} = other = 2

class Box{k}:
    size{k}: int = 4
    _hid{k} = 1
""", [("LIMIT{k}", "variable", None, "int", False, False), ("_own{k}", "variable", None, None, True, False), ("both{k}", "variable", None, None, False, False), ("other", "variable", None, None, False, False), ("Box{k}", "class", None, None, False, False), ("size{k}", "property", "Box{k}", "int", False, True), ("_hid{k}", "property", "Box{k}", None, True, True)])  # fmt: skip

_NAMES = """def seen{k}():
    return 1

def _hid{k}():
    return 2

class Box{k}:
    pass
"""
source_query("s7h_python_exports", ".py", "exports", "export_name", _NAMES, [("seen{k}",), ("Box{k}",)])
source_query("s7h_python_all", ".py", "exports", "export_name", '__all__ = ["_hid{k}", "Box{k}"]\n\n' + _NAMES, [("_hid{k}",), ("Box{k}",)])

source_query("s7i_python_calls", ".py", "calls", "caller_name callee_name call_count", """class Box{k}:
    def run{k}(self):
        helper{k}(self.x)
        if self.ok:
            helper{k}(2)
        return self.other{k}()
""", [("Box{k}.run{k}", "helper{k}", 2), ("Box{k}.run{k}", "other{k}", 1)])  # fmt: skip

source_query("s7_python_errors", ".py", "symbols", "name line_start", """def good{k}(a):
    return a

def bad{k}(a:
    return a

LIMIT{k} = {s}
""", [("good{k}", 1), ("LIMIT{k}", 7)], about="What has no error in its syntax is kept")  # fmt: skip

_PACKAGE = '{\n  "name": "pkg{k}",\n  "scripts": {\n    "build": "make {s}"\n  },\n  "files": ["a", {s}],\n  "private": true\n}\n'
source_query("s8_json_entries", "/package.json", "config_entries", "path value_type value depth parent_path line_number config_type description", _PACKAGE, [
    ("name", "string", "pkg{k}", 0, None, 2, "package.json", "Package name"), ("scripts", "object", '{"build": "make {s}"}', 0, None, 3, "package.json", "NPM scripts"), ("scripts.build", "string", "make {s}", 1, "scripts", 4, "package.json", None),
    ("files", "array", '["a", {s}]', 0, None, 6, "package.json", "Files to include in package"), ("files[0]", "string", "a", 1, "files", 1, "package.json", None), ("files[1]", "number", "{s}", 1, "files", 1, "package.json", None),
    ("private", "boolean", "true", 0, None, 7, "package.json", None),
], stem="app/f{k}.d", about="JSON as one row for each node (S8, S10, S11, F13)")
source_query("s8_toml_entries", "/pyproject.toml", "config_entries", "path value_type value depth config_type description", '[project]\nname = "p{k}"\n[tool.ruff]\nline = {s}\n', [
    ("project", "object", '{"name": "p{k}"}', 0, "pyproject", "Project metadata"), ("project.name", "string", "p{k}", 1, "pyproject", "Package name"), ("tool", "object", '{"ruff": {"line": {s}}}', 0, "pyproject", "Tool-specific configurations"),
    ("tool.ruff", "object", '{"line": {s}}', 1, "pyproject", "Ruff linter configuration"), ("tool.ruff.line", "number", "{s}", 2, "pyproject", None),
], stem="app/f{k}.d", about="TOML as rows (S8, S11, F19)")


@query("s12_size_limit", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'skipped' ELSE 'complete' END AS parse_status, CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS n FROM part")
def size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files over the limit are recorded, not parsed."""
    rows = dealt(b.table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path"), F.concat(F.lit("x = 1\n#"), F.expr("repeat('.', p_size)")).alias("content"))
    found = ingest.parse_files(rows.withColumn("file_size", F.octet_length("content").cast("long")), limit=32)
    n = found.groupBy("file_path").agg(F.max(F.when(F.col("relation") == "files", F.get_json_object("payload", "$.parse_status"))).alias("parse_status"), F.sum((F.col("relation") == "symbols").cast("int")).cast("int").alias("n"))
    return rows.select("p_partkey", "file_path").join(n, "file_path").select("p_partkey", "parse_status", "n")


_ENDINGS = ".ts .TSX .js .py .pyi .json .md .yaml .mjs .d".split()


@query("s4_parser_dispatch", "SELECT 'f' || i || e AS path, CASE WHEN lower(e) IN ('.ts', '.tsx') THEN 'typescript' WHEN lower(e) IN ('.js', '.mjs') THEN 'javascript' WHEN lower(e) IN ('.py', '.pyi') THEN 'python' WHEN lower(e) IN ('.json', '.yaml') THEN 'config' END AS language FROM (SELECT p_partkey AS i, (['.ts', '.TSX', '.js', '.py', '.pyi', '.json', '.md', '.yaml', '.mjs', '.d'])[1 + p_size % 10] AS e FROM part)")
def parser_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the last ending, in lower case."""
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_size") % 10 + 1).cast("int"))
    path = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), ending)
    return b.table(spark, sf_dir, "part").select(path.alias("path")).withColumn("language", ingest.language_of(F.col("path")))


@query("s2_default_globs", """SELECT path, NOT regexp_matches(path, '(^|/)(node_modules|dist|build|[.]git|venv|__pycache__)/') AND regexp_matches(path, '[.](ts|tsx|js|jsx|py)$|(^|/)(package|tsconfig([.][^/]*)?|jsconfig)[.]json$|(^|/)pyproject[.]toml$|(^|/)docker-compose[^/]*[.]ya?ml$|(^|/)[.]github/workflows/[^/]+[.]ya?ml$') AS taken
FROM (SELECT p_partkey || '/' || (['src', 'a/node_modules/b', 'dist', 'venv/lib', 'x/__pycache__', '.github/workflows', 'lib', '.git'])[1 + p_size % 8] || '/' || (['a.ts', 'b.py', 'package.json', 'data.json', 'tsconfig.base.json', 'docker-compose.dev.yml', 'ci.yaml', 'pyproject.toml', 'c.md', 'd.jsx'])[1 + p_partkey % 10] AS path FROM part)""")
def default_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ["src", "a/node_modules/b", "dist", "venv/lib", "x/__pycache__", ".github/workflows", "lib", ".git"])), (F.col("p_size") % 8 + 1).cast("int"))
    base = F.element_at(F.array(*map(F.lit, ["a.ts", "b.py", "package.json", "data.json", "tsconfig.base.json", "docker-compose.dev.yml", "ci.yaml", "pyproject.toml", "c.md", "d.jsx"])), (F.col("p_partkey") % 10 + 1).cast("int"))
    path = F.concat_ws("/", F.col("p_partkey").cast("string"), folder, base)
    return b.table(spark, sf_dir, "part").select(path.alias("path")).withColumn("taken", ingest.taken(F.col("path")))


@query("s13_source_slices", "SELECT p_partkey, 'l' || greatest(1, p_size % 7) || chr(10) || 'l' || (greatest(1, p_size % 7) + 1) AS lines FROM part")
def source_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file by number, clamped to what there is."""
    rows = b.table(spark, sf_dir, "part").withColumn("content", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("l"), i.cast("string"))), "\n"))
    at = (F.col("p_size") % 7).cast("int")
    return rows.select("p_partkey", ingest.source_slice(F.col("content"), F.greatest(at, F.lit(1)), F.greatest(at, F.lit(1)) + 1).alias("lines"))
