"""Workflow files by indentation."""

from gitstrata.operators import deps

TEXT = """# permissions: write-all
name: "a: b"
on:
  push:
permissions:
  contents: read   # all else is none
env: {A: 1}
jobs:
  one:
    permissions: {}
    runs-on: x
    steps:
      - uses: actions/checkout@v4
        with:
          uses: nothing/here@v1
      - name: text
        run: >-
          uses: nothing/there@v1

          jobs:
      - name: last
        uses: 'acme/tool@main'
  two:
    uses: ./.github/workflows/own.yml
    permissions:
      id-token: write
  three:
    steps:
    - run: |
        permissions: write-all
    - uses: b/c@v1
    permissions: read-all
"""


def test_uses_and_permissions(spark):
    files = spark.createDataFrame([("w.yml", TEXT), ("silent.yml", "on: push\r\njobs:\r\n  a:\r\n    steps:\r\n    - uses: x/y@v2\r\n"), ("empty.yml", ""), ("null.yml", None), ("odd.yml", "permissions:\njobs: none\n- permissions: write-all\n")], "path string, content string")
    assert sorted((r.workflow, r.uses) for r in deps.workflow_manifest(files).collect()) == [
        ("silent.yml", "x/y@v2"), ("w.yml", "./.github/workflows/own.yml"), ("w.yml", "acme/tool@main"), ("w.yml", "actions/checkout@v4"), ("w.yml", "b/c@v1"),
    ]
    got = {(r.workflow, r.job): r.scope for r in deps.workflow_permissions(files).collect()}
    assert got == {
        ("w.yml", None): "granular", ("w.yml", "one"): "granular", ("w.yml", "two"): "granular", ("w.yml", "three"): "read-all", ("silent.yml", None): "unspecified",
        ("empty.yml", None): "unspecified", ("null.yml", None): "unspecified", ("odd.yml", None): "unspecified",
    }


def test_texts_of_one_split_are_dealt(spark):
    files = spark.createDataFrame([(f"w{k}.yml", TEXT) for k in range(200)], "path string, content string").coalesce(1)
    held = [n for n in deps.workflow_keys(files).rdd.mapPartitions(lambda rows: [len({r.workflow for r in rows})]).collect() if n]
    assert len(held) > 3 and sum(held) == 200
