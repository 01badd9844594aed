"""Claims of functions and scripts, and the shape of their persistence, by hand."""

from klarspan.operators import function_claims as C

PY = '''
class OrderStore:
    @router.delete("/orders")
    async def handle(self, x):
        """Guard of the tenant."""
        def get_inner():
            return self.repo.find_one(x).upsert()
        await self.session.execute_write("CREATE (a:Order)-[r:OF]->(b:Customer) DELETE a")
        return get_inner()


def create_version(x):
    api_adapter(x)
'''


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_functions(spark):
    files = spark.createDataFrame([("a", PY), ("a", PY), ("bad", "def ("), ("empty", ""), (None, None), ("long", "def read_it():\n" + "    x = 1\n" * 20000)], "source_id string, text string")
    functions = C.functions_of(files).distinct().cache()
    assert rows(functions, "source_id", "func", "first_line") == {("a", "OrderStore.handle", 4), ("a", "OrderStore.handle.get_inner", 6), ("a", "create_version", 12), ("long", "read_it", 1)}
    claims = C.function_claims(functions, ())
    assert rows(claims, "source_id", "subject_key", "predicate", "section_path") == {
        ("a", "OrderStore.write_path", "implemented_write", "OrderStore.handle"), ("a", "OrderStore.policy", "implemented_policy", "OrderStore.handle"), ("a", "OrderStore.read_path", "implemented_read", "OrderStore.handle.get_inner"),
        ("a", "create_version.write_path", "implemented_write", "create_version"), ("long", "read_it.read_path", "implemented_read", "read_it"),
    }
    assert claims.where("length(value) > 180").count() == 0


def test_persistence(spark):
    files = spark.createDataFrame([("a", PY)], "source_id string, text string")
    got = rows(C.persistence(C.functions_of(files)), "func", "kind", "name")
    handle, inner, create = "OrderStore.handle", "OrderStore.handle.get_inner", "create_version"
    assert got == {
        (handle, "backend", "neo4j"), (handle, "operation", "neo4j_query_write"), (handle, "operation", "repository_upsert"), (handle, "operation", "neo4j_create_relationship"), (handle, "operation", "neo4j_create_node"), (handle, "operation", "neo4j_delete"),
        (handle, "target", "Node:Order"), (handle, "target", "Node:Customer"), (handle, "target", "Relationship:OF"), (inner, "backend", "repository"), (inner, "operation", "repository_upsert"),
        (create, "backend", "repository"), (create, "operation", "history_append"), (create, "target", "History:CreateVersion"),
    }


TS = "// notes about the approval\r\nimport y\n\nexport default async function saveOrder(x) {\n  return api.post(x)\n\n  const status = x.status || load(x)\n}\nlet z = 1\n"


def test_scripts(spark):
    files = spark.createDataFrame([("a", "Page", TS), ("a", "Page", TS), ("b", None, ""), (None, None, None)], "source_id string, title string, text string")
    blocks = C.script_blocks(files)
    assert rows(blocks, "symbol", "first_line", "last_line") == {("Page", 1, 2), ("saveOrder", 4, 5), ("status", 7, 8)}
    assert rows(C.script_claims(blocks, ()), "subject_key", "section_path") == {("Page.policy", "Page"), ("Page.write_path", "saveOrder"), ("Page.read_path", "status"), ("Page.lifecycle", "status")}
