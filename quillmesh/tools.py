"""The thirteen questions that an index answers, each as a DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.thesaurus import thesaurus
from quillmesh.operators import bundles, factored, graph, lookups, markov, search
from quillmesh.operators.aggregates import fan_out, module_name
from quillmesh.operators.imports import entry_points, excluded, package_name
from quillmesh.operators.lookups import FUNCTION_KINDS
from quillmesh.operators.lookups import list_files as files_below
from quillmesh.operators.retrieval import callee_package, glob_regex, is_test_path, paginate, resolve_types, section, type_names, within_budget
from quillmesh.sources.ingest import scan, source_slice
from quillmesh.sources.store import MOST_NAMED, Store, type_tables
from quillmesh.sources.ts_parser import TEST_CALLS
from quillmesh.streaming.watch import MANY_CHANGES

FOCUS = ("full", "modules", "core_classes", "dependencies", "entry_points", "public_api", "patterns", "key_types")


class Tools:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def search_symbols(
        self, query: str | None = None, kind: str | None = None, language: str | None = None, limit: int = 20, expand_synonyms: bool = True, return_type: str | None = None, param_type: str | None = None, match_mode: str = "base",
    ) -> DataFrame:
        """By name, ranked by BM25 and synonyms, approximate matches where there is no exact one; or by types, with the query as a filter of names."""
        symbols = self.store.read("symbols")
        symbols = symbols if kind in (None, "all") else symbols.filter(F.col("kind").isin(*FUNCTION_KINDS) if kind == "function" else F.col("kind") == kind)
        symbols = symbols if language is None else symbols.filter(F.col("language") == language)
        if return_type or param_type:
            types, params = type_tables(symbols)
            found = search.by_types(types, params, return_type, param_type, match_mode, 3 * limit if query else limit)
            rows = found.join(symbols.select(F.col("id").alias("symbol_id"), "kind", "signature", "file_path", "line_start"), "symbol_id").withColumnsRenamed({"symbol_id": "id", "symbol_name": "name"})
            for word in (query or "").lower().split():
                rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "name", "signature", "file_path")), F.lit(word)))
            return rows.orderBy("name", "id").limit(limit)
        query = query or ""
        words = search.query_terms(query) or [query.lower()]
        asked = self.spark.createDataFrame([(query, w) for w in words], "query string, word string")
        terms = [(t["term"], t["weight"], t["source"]) for t in search.expand_terms(asked, thesaurus(self.spark)).collect()] if expand_synonyms else [(w, 1.0, "original") for w in words]  # at most MOST_TERMS
        rows = symbols.select("id", "name", "kind", "signature", "file_path", "line_start", "fully_qualified_name")
        text = query if not expand_synonyms or re.search(r'[*"]|\sOR\s', query) else " OR ".join([query, *(f'"{t}"*' for t, _, s in terms if s != "original")])
        # without a filter the index itself finds the best; with one, all its hits are filtered first
        found = self.store.search("symbols", text, k=search.over_fetch(limit) if kind in (None, "all") and language is None else None)
        hits = search.by_name(rows, "id", {}, text, terms, limit, found)
        if not hits.limit(1).count():
            close = search.fuzzy(symbols, "id", ["name", "fully_qualified_name", "signature"], query)
            hits = search.rerank(close.join(rows, "id"), terms).orderBy(F.desc(F.round("combined", 9)), "id").limit(limit)
        return hits.drop("fully_qualified_name")

    def _symbol(self, name: str, kinds: tuple[str, ...]) -> DataFrame:
        rows = self.store.read("symbols").filter(F.col("kind").isin(*kinds))
        hit = F.when(F.col("name") == name, 1).when(F.col("local_name") == name, 2).when(F.lit("." in name) & F.concat_ws(".", "parent_class", "name").endswith(name), 3)
        found = rows.withColumn("how", hit).filter("how is not null")
        best = found.agg(F.min("how").alias("how"))
        return found.join(F.broadcast(best), "how").drop("how").orderBy("file_path", "line_start")  # best: one row

    def get_function(self, name: str, path: str | None = None, folder: str | None = None, context: int = 0) -> DataFrame:
        """All rows of the first rung that has any; more than one means the name is ambiguous (L4, L5, Q8). With a path, functions of the files that end with it.

        With the folder of the sources, their lines too, and some around them.
        """
        found = self._symbol(name, FUNCTION_KINDS)
        found = found if path is None else found.filter(F.col("file_path").endswith(path))
        return found if folder is None else self._with_source(found, folder, context).orderBy("file_path", "line_start")

    def _with_source(self, rows: DataFrame, folder: str, context: int) -> DataFrame:
        """Rows with the lines they stand on, as the files are now; only files of these rows are read."""
        paths = [r[0] for r in rows.select("file_path").distinct().limit(MOST_NAMED + 1).collect()]
        if len(paths) > MOST_NAMED:
            raise ValueError(f"over {MOST_NAMED} files have that name; give a path")
        text = scan(self.spark, folder, only=paths).select("file_path", "content")
        return rows.join(text, "file_path", "left").withColumn("source", source_slice(F.col("content"), F.col("line_start"), F.col("line_end"), context)).drop("content")

    def suggestions(self, name: str) -> list[str]:
        """Names that are meant by an ambiguous one, in order."""
        found = lookups.function_details(self.store.read("symbols"), self.spark.createDataFrame([(name,)], "query string"))
        return found.first()["suggestions"]

    def get_class(self, name: str, methods_only: bool = False, inherited: bool = False, folder: str | None = None) -> DataFrame:
        """A class, or else an interface, with its members (L6, L7, Q9); inherited: also those of what it extends, unless it has its own of that name.

        inherited_from tells whose they are. With the folder of the sources, their lines too.
        """
        own = self._symbol(name, ("class", "interface"))
        symbols = self.store.read("symbols")
        members = symbols.filter(F.col("parent_class") == name)
        rows = own.unionByName(members).withColumn("inherited_from", F.lit(None).cast("string"))
        if inherited:
            up = self.store.read("type_rels").filter("relationship_kind = 'extends'").select(F.col("source_name").alias("src"), F.col("target_name_base").alias("dst")).distinct()
            above = graph.reachable(up, self.spark.createDataFrame([(name,)], "node string"), 10).filter("depth > 0").select(F.col("node").alias("parent_class"), "depth")
            theirs = symbols.join(above, "parent_class").join(members.select("local_name"), "local_name", "left_anti").filter(F.col("kind") != "constructor")
            nearest = theirs.groupBy("local_name").agg(F.min("depth").alias("depth"))
            rows = rows.unionByName(theirs.join(nearest, ["local_name", "depth"]).withColumn("inherited_from", F.col("parent_class")).select(*rows.columns))
        rows = rows.filter(F.col("kind").isin("class", "interface", "method", "constructor")) if methods_only else rows
        rows = rows if folder is None else self._with_source(rows, folder, 0)
        return rows.orderBy("file_path", "line_start")

    def get_alias(self, name: str) -> DataFrame:
        return self._symbol(name, ("type",))

    def get_variable(self, name: str) -> DataFrame:
        return self._symbol(name, ("variable",))

    def list_functions(self, path: str, include_private: bool = True) -> DataFrame:
        """Symbols of a file by section: functions, nested ones under their parent, callbacks by kind, classes, interfaces, aliases (Q3)."""
        rows = self.store.read("symbols").filter((F.col("file_path") == path) | F.col("file_path").endswith(f"/{path}"))
        rows = rows if include_private else rows.filter(~F.coalesce("is_private", F.lit(False)))
        rows = rows.withColumn("section", section(F.col("kind"), F.col("callback_context"), F.col("parent_function"), TEST_CALLS)).filter("section <> 'member' and kind <> 'variable'")
        return rows.select("section", "id", "name", "kind", "parent_function", "line_start", "line_end", "is_exported", "is_async", "is_private", "signature").orderBy("line_start", "id")

    def list_files(self, directory: str | None = None, language: str | None = None, exclude: list[str] = (), include_tests: bool = False, page: int = 1, size: int = 50) -> DataFrame:
        rows = files_below(self.store.read("files"), directory, language)
        for g in exclude:
            rows = rows.filter(~F.col("file_path").rlike(glob_regex(g)))
        rows = rows if include_tests else rows.filter(~is_test_path(F.col("file_path")))
        return paginate(rows, [F.col("file_path").asc()], page, size)

    def find_references(self, name: str, kind: str | None = None, path: str | None = None, limit: int = 50) -> DataFrame:
        refs = self.store.read("refs").filter(F.col("symbol_name") == name)
        refs = refs if kind is None else refs.filter(F.col("reference_kind") == kind)
        refs = refs if path is None else refs.filter(F.col("referencing_file").contains(path))
        return paginate(refs, [F.col("referencing_file").asc(), F.col("line_number").asc(), F.col("column_number").asc()], 1, limit)

    def trace_calls(self, name: str, direction: str = "callees", depth: int = 1) -> DataFrame:
        """Edges by name, up to three levels (T1); callers from references where no edge is known."""
        calls = self.store.read("calls").select(F.col("caller_name").alias("src"), F.col("callee_name").alias("dst")).distinct()
        root = self.spark.createDataFrame([(name,)], "node string")
        back = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        edges = {"callees": calls, "callers": back, "both": graph.both_ways(calls)}[direction]
        found = graph.walked_edges(edges, root, min(3, max(1, depth)))
        if direction == "callers" and not found.limit(1).count():
            refs = self.store.read("refs").filter((F.col("symbol_name") == name) & (F.col("reference_kind") == "call") & F.col("referencing_symbol_name").isNotNull())
            return refs.select(F.lit(name).alias("src"), F.col("referencing_symbol_name").alias("dst"), F.lit(1).alias("depth")).distinct()
        return found

    def trace_types(self, name: str, direction: str = "both", depth: int = 5) -> DataFrame:
        rels = self.store.read("type_rels").select(F.col("source_name").alias("src"), F.col("target_name_base").alias("dst")).distinct()
        back = rels.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        edges = {"up": rels, "down": back, "both": graph.both_ways(rels)}[direction]
        return graph.reachable(edges, self.spark.createDataFrame([(name,)], "node string"), depth)

    def get_module_dependencies(self, path: str, depth: int = 3, include_external: bool = False, include_types: bool = True, reverse: bool = False) -> DataFrame:
        """Files that a file imports, and theirs, to five levels; or those that import it; with external packages if asked."""
        found = self.store.resolved_imports()
        found = found if include_types else found.filter(~F.coalesce("is_type_only", F.lit(False)))
        edges = found.filter("resolved_path is not null").select(F.col("file").alias("src"), F.col("resolved_path").alias("dst")).distinct()
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges
        out = graph.reachable(edges, self.spark.createDataFrame([(path,)], "node string"), min(5, depth)).withColumn("external", F.lit(False))
        if include_external and not reverse:
            packages = found.filter((F.col("file") == path) & (F.col("kind") != "internal")).select(package_name(F.col("source")).alias("node")).distinct()
            out = out.unionByName(packages.withColumn("depth", F.lit(1)).withColumn("external", F.lit(True)), allowMissingColumns=True)
        return out

    def suggest_related(self, name: str, limit: int = 10, chains: tuple[str, ...] | None = None) -> DataFrame:
        """Walks over the stored factors of the chains from the first symbol of that name, merged by weight; without support callers, callees and neighbours."""
        symbols = self.store.read("symbols")
        start = symbols.filter((F.col("name") == name) | (F.col("local_name") == name)).agg(F.min("id")).first()[0]
        if start is None:
            return self.spark.createDataFrame([], "state string, score double, hops int, chains array<string>, reason string")
        step, walked = self.store.walks(), None
        for chain in chains or markov.CHAIN_WEIGHTS:
            one = factored.walk(self.spark, start, step[chain]).withColumn("chain", F.lit(chain))
            walked = one if walked is None else walked.unionByName(one)
        found = markov.merge_chains(walked).orderBy(F.desc(F.round("score", 9)), "state").limit(limit).withColumn("reason", F.lit("chains"))
        if found.limit(1).count():
            return found
        calls = self.store.resolved_calls()
        callers = calls.filter(F.col("callee_symbol_id") == start).select(F.col("caller_symbol_id").alias("state"))
        callees = calls.filter(F.col("caller_symbol_id") == start).select(F.coalesce("callee_symbol_id", "callee_name").alias("state"))
        home = symbols.filter(F.col("id") == start).select("file_path").limit(1)
        near = symbols.join(F.broadcast(home), "file_path").filter(F.col("id") != start).select(F.col("id").alias("state"))  # home: one row
        none = (F.lit(None).cast("int").alias("hops"), F.array().cast("array<string>").alias("chains"))
        return markov.fallback(callers, callees, near, limit).select("state", "score", *none, "reason")

    def get_related_context(self, name: str, budget: int = 16_000, include_tests: bool = False) -> DataFrame:
        """The symbol, the types its signature names, its callees, and tests that refer to it, as far as the budget goes (Q7, Q11, Q12, Q13, Q17)."""
        symbols = self.store.read("symbols").withColumn("size", F.length("signature") + F.coalesce(F.length("doc"), F.lit(0)))
        own = symbols.filter(F.col("local_name") == name).withColumn("rank", F.lit(0))
        named = own.select(F.explode(type_names(F.col("signature"), ["Promise", "Array", "Map", "Set", "Record"])).alias("name")).distinct()
        types = symbols.filter(F.col("kind").isin("interface", "type", "class")).join(named, "name", "left_semi").withColumn("rank", F.lit(1))
        callees = self.trace_calls(name).select(F.col("dst").alias("local_name")).distinct()
        parts = own.unionByName(types).unionByName(symbols.join(callees, "local_name", "left_semi").withColumn("rank", F.lit(2)))
        if include_tests:
            files = self.store.read("refs").filter((F.col("symbol_name") == name) & is_test_path(F.col("referencing_file"))).select(F.col("referencing_file").alias("file_path")).distinct()
            tests = symbols.filter((F.col("kind") == "callback") & F.col("callback_context").isin(*TEST_CALLS)).join(files, "file_path", "left_semi")
            parts = parts.unionByName(tests.withColumn("rank", F.lit(3)))
        once = parts.groupBy("id").agg(F.min_by(F.struct(*parts.columns), "rank").alias("x")).select("x.*")
        return within_budget(once, [], [F.col("rank").asc(), F.col("id").asc()], "size", budget)

    def get_context_bundle(
        self, name: str, folder: str, path: str | None = None, max_tokens: int = 8000, include_types: bool = True, include_callees: bool = True, include_tests: bool = False, callee_depth: int = 1,
    ) -> DataFrame:
        """A function with its source, the types its signature names, what it calls to two levels, and the first five tests around references to it (Q11-Q20).

        section, place, name, file_path, line_start, package (that the name of a callee tells of), framework (of a test), source, tokens,
        estimated_tokens: each section has its share of the tokens, and each item an equal part of it. folder: of the sources; a file that
        is there no more leaves the signature. Of an ambiguous name the first function in order of files is taken. No row if there is none.
        """
        symbols = self.store.read("symbols")
        own = self.get_function(name, path).orderBy("file_path", "line_start").limit(1)
        head = own.select("id", "signature").first()
        columns = ("section", "place", "name", "file_path", "line_start", "line_end", "signature", "package", "framework")
        rows = lambda df, part, place: df.select(F.lit(part).alias("section"), place.cast("long").alias("place"), *[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns[2:]])
        found = rows(own, "symbol", F.lit(0))
        if head is not None and include_types:
            named = own.select(F.explode(type_names(F.col("signature"), ["Promise", "Array", "Map", "Set", "Record"])).alias("type_name"))
            first = resolve_types(named, symbols).filter("kind is not null")
            types = symbols.join(first.select(F.col("type_name").alias("name"), "kind", "file_path", "line_start"), ["name", "kind", "file_path", "line_start"], "left_semi")
            found = found.unionByName(rows(types, "types", F.lit(0)))
        if head is not None and include_callees:
            calls = self.store.resolved_calls()
            near, seen = calls.filter(F.col("caller_symbol_id") == head["id"]), None
            for depth in range(1, min(2, max(1, callee_depth)) + 1):
                level = near.select("callee_name", "callee_symbol_id", F.lit(depth).alias("depth"))
                seen = level if seen is None else seen.unionByName(level)
                near = calls.join(level.filter("callee_symbol_id is not null").select(F.col("callee_symbol_id").alias("caller_symbol_id")).distinct(), "caller_symbol_id", "left_semi")
            once = seen.groupBy("callee_name", "callee_symbol_id").agg(F.min("depth").alias("depth"))
            about = symbols.select(F.col("id").alias("callee_symbol_id"), "file_path", "line_start", "line_end", "signature")
            callees = once.join(about, "callee_symbol_id", "left").withColumn("name", F.col("callee_name")).withColumn("package", F.when(F.col("callee_symbol_id").isNull(), callee_package(F.col("callee_name"))))
            found = found.unionByName(rows(callees, "callees", F.col("depth")))
        wanted = found.filter("file_path is not null").select("file_path")
        refs = self.store.read("refs").filter((F.col("symbol_name") == name) & is_test_path(F.col("referencing_file"))).select("symbol_name", F.col("referencing_file").alias("file_path"), "line_number")
        wanted = (wanted.union(refs.select("file_path")) if include_tests else wanted).distinct()
        paths = [r[0] for r in wanted.limit(MOST_NAMED + 1).collect()]
        if len(paths) > MOST_NAMED:
            raise ValueError(f"over {MOST_NAMED} files belong to that name; give a path, or leave tests out")
        texts = scan(self.spark, folder, only=paths).select("file_path", "content")
        lined = found.join(texts, "file_path", "left").withColumn("source", F.coalesce(source_slice(F.col("content"), F.col("line_start"), F.col("line_end")), "signature")).drop("content", "line_end", "signature")
        if include_tests and head is not None:
            tests = bundles.first_places(bundles.enclosing_tests(refs, texts), ["symbol_name"], ["file_path", "line_number"]).join(texts, "file_path")
            block = bundles.block_at(F.split("content", "\n"), F.col("line_number") - 1)
            tests = tests.select(F.lit("tests").alias("section"), F.lit(0).cast("long").alias("place"), "name", "file_path", F.col("line_number").alias("line_start"), F.lit(None).cast("string").alias("package"), "framework", block.alias("source"))
            lined = lined.unionByName(tests)
        return bundles.fitted(bundles.shared_out(lined, [], F.lit(max_tokens), include_tests), "source").orderBy("section", "place", "name", "file_path", "line_start")

    def get_architecture_overview(self, focus: str = "modules", entry_file: str | None = None) -> DataFrame:
        """One of the views of FOCUS (Q21): modules (also core_classes), dependencies, entry_points, public_api, patterns, key_types, or full, all sections of these as name, detail and n."""
        if focus not in FOCUS:
            raise ValueError(f"focus must be one of {', '.join(FOCUS)}")
        symbols, files = self.store.read("symbols"), self.store.read("files")
        files = files.filter(~excluded(F.col("file_path")))
        if focus in ("modules", "core_classes"):
            own = files.withColumn("module", module_name(F.col("file_path")))
            exports = self.store.read("exports").groupBy("file_path").agg(F.count("*").alias("n"))
            return own.join(exports, "file_path", "left").groupBy("module").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("exports")).orderBy("module")
        if focus == "dependencies":
            edges = self.store.resolved_imports().filter("resolved_path is not null").select(module_name(F.col("file")).alias("module"), module_name(F.col("resolved_path")).alias("uses"))
            return edges.filter("module <> uses").groupBy("module", "uses").agg(F.count("*").alias("n")).orderBy("module", "uses")
        if focus == "entry_points":
            entries = self.store.read("config_entries").filter(F.col("config_type") == "package.json")
            root = entries.agg(F.min(F.struct(F.length("file_path"), "file_path")).alias("x")).select(F.col("x.file_path").alias("file_path"))  # the shortest path
            return entry_points(files, entries.join(F.broadcast(root), "file_path"), entry_file).orderBy("file_path")
        if focus == "public_api":
            entry = self.get_architecture_overview("entry_points", entry_file).select("file_path")
            exports = self.store.read("exports").join(files.select("file_path"), "file_path", "left_semi")
            some = exports.join(entry, "file_path", "left_semi") if entry.limit(1).count() else exports
            kinds = symbols.filter("is_exported").groupBy(F.col("name").alias("export_name")).agg(F.min("kind").alias("kind"))
            return some.filter("export_name <> '*'").join(kinds, "export_name", "left").select("export_name", "kind", "file_path", "re_export_source").orderBy("export_name", "file_path")
        if focus == "patterns":
            rels = self.store.read("type_rels").select(F.col("target_name_base").alias("target"), F.col("relationship_kind").alias("kind"), F.col("source_name").alias("source"))
            return fan_out(rels).orderBy(F.desc("children"), "target", "kind")
        if focus == "key_types":
            refs = self.store.read("refs").groupBy(F.col("symbol_name").alias("name")).agg(F.count("*").alias("n"))
            return symbols.filter(F.col("kind").isin("class", "interface", "type") & ~excluded(F.col("file_path"))).join(refs, "name", "left").select("name", "kind", "file_path", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "name", "file_path")
        parts = {
            "modules": ("module", F.concat_ws(" ", F.col("files").cast("string"), F.lit("files")), "lines"), "dependencies": ("module", F.col("uses"), "n"), "entry_points": ("file_path", F.concat_ws(": ", "type", "reason"), None),
            "public_api": ("export_name", F.concat_ws(" ", "kind", "file_path"), None), "patterns": ("target", F.col("kind"), "children"), "key_types": ("name", F.concat_ws(" ", "kind", "file_path"), "n"),
        }
        out = None
        for view, (name, detail, n) in parts.items():
            rows = self.get_architecture_overview(view, entry_file).select(F.lit(view).alias("view"), F.col(name).alias("name"), detail.alias("detail"), (F.col(n) if n else F.lit(None)).cast("long").alias("n"))
            out = rows if out is None else out.unionByName(rows)
        return out.orderBy("view", "name", "detail")

    def sync_index(self, folder: str, full: bool = False, paths: list[str] | None = None) -> DataFrame:
        """Bring the index up to date, or the files named (M12). Chains follow from MANY_CHANGES files on that were indexed or removed, or with full."""
        report = self.store.index(folder, full, paths=paths)
        rebuild = full or report["indexed"] - report["failed"] + report["removed"] >= MANY_CHANGES
        if full:
            self.store.build_factors()
        elif rebuild:
            self.store.update_factors()
        return self.spark.createDataFrame([(report["indexed"], report["removed"], report["failed"], rebuild)], "indexed long, removed long, failed long, rebuild boolean")

    def stats(self) -> DataFrame:
        return self.store.read("symbols").groupBy("language", "kind").agg(F.count("*").alias("n")).orderBy("language", "kind")
