"""Drafts of connectors from OpenAPI documents, Swagger documents and curl commands."""

import json

from folioforge.sources import manifests


def openapi(spark, *specs):
    rows = spark.createDataFrame([(i, s if s is None or isinstance(s, str) else json.dumps(s)) for i, s in enumerate(specs)], "n int, s string")
    return {(r.n, r.id): r for r in manifests.from_openapi(rows, "n", "s").collect()}


def curl(spark, *commands):
    rows = spark.createDataFrame(list(enumerate(commands)), "n int, c string")
    return [r for r in manifests.from_curl(rows, "n", "c").orderBy("n").collect()]


def test_openapi_and_swagger(spark):
    three = {"servers": [{"url": "https://h.invalid/v2/"}], "paths": {
        "/items/{id}": {
            "parameters": [{"name": "id", "in": "path", "schema": {"type": "integer"}}, {"name": "q", "in": "query", "schema": {"type": "boolean"}}],
            "get": {"operationId": "Get Item!", "summary": "one", "parameters": [{"name": "q", "in": "query", "required": True, "schema": {"type": "string", "default": "x"}}, {"$ref": "#/c"}, {"name": "api_key", "in": "query"}, {"name": "h", "in": "header"}]},
            "put": {"operationId": "put"}, "summary": "text",
        },
        "/find": {"POST": {"parameters": [{"name": "9-n", "in": "query", "schema": {"type": "number"}}]}},
    }}
    two = {"host": "s.invalid", "basePath": "/b", "schemes": ["http"], "paths": {"/": {"get": {"parameters": [{"name": "k", "in": "query", "type": "integer"}]}}}}
    made = openapi(spark, three, two, "no json", None, {"paths": {}}, {"openapi": "3"})
    assert set(made) == {(0, "get_item"), (0, "post_find"), (1, "get")}
    one = made[0, "get_item"]
    assert (one.base_url, one.method, one.path, one.summary) == ("https://h.invalid/v2", "GET", "/items/{id}", "one")
    assert [tuple(p) for p in one.params] == [("q", "q", "query", "string", True, "x"), ("id", "id", "path", "int", True, None)]
    assert [tuple(p) for p in made[0, "post_find"].params] == [("p_9_n", "9-n", "query", "number", False, None)]
    assert made[1, "get"].base_url == "http://s.invalid/b" and made[1, "get"].params[0].type == "int"


def test_curl_commands(spark):
    made = curl(
        spark,
        "curl -X GET 'https://h.invalid:8/a/Find-It/?q=two%20words&n=5&flag&access_key=s#top' -H 'Accept: application/json'",
        "curl \\\n  -H \"Authorization: Bearer abc\" --json '{\"a\": 1}' http://h.invalid", "curl -H 'X-Api-Key: k' -d 'http://not.invalid' --url http://h.invalid/x",
        "curl -XPUT", "curl --request delete http://h.invalid/", "wget http://h.invalid/", "", None, "curl -u a:b http://h.invalid/%zz?x=%zz",
    )
    first = made[0]
    assert (first.base_url, first.id, first.method, first.path, first.auth, first.refused) == ("https://h.invalid:8", "find_it", "GET", "/a/Find-It/", "query", None)
    assert [(p.name, p.type, p.default) for p in first.params] == [("q", "string", "two words"), ("n", "int", "5"), ("flag", "string", "")]
    assert (made[1].method, made[1].path, made[1].id, made[1].auth) == ("POST", "/", "query", "bearer")
    assert (made[2].base_url, made[2].path, made[2].method, made[2].auth) == ("http://h.invalid", "/x", "POST", "header")
    assert [m.refused for m in made[3:8]] == ["no address", "changes data", "not curl", "not curl", "not curl"]
    assert made[4].base_url is None and made[4].params is None
    assert made[8].auth == "basic" and made[8].params[0].default == "%zz"


def test_no_secret_is_held(spark):
    text = json.dumps([r.asDict(True) for r in curl(spark, "curl -u me:hush1 -H 'Authorization: Bearer hush2' 'http://h.invalid/?token=hush3' -H 'X-Secret: hush4'")])
    assert "hush" not in text
