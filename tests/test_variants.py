"""Targets of definitions by their conditions, variants and where they diverge."""

from __future__ import annotations

from lattica.operators import variants as V

TREE = {
    "src/io.c": "#ifdef _WIN32\nint load(int x)\n{\n  win_open(x);\n}\n#elif defined(__APPLE__)\nint load(int x)\n{\n  mac_open(x);\n  log_it(x);\n}\n#else\n#if HAVE_SOUND\nint sound(int x)\n{\n}\n#endif\nint load(int x)\n{\n  posix_open(x);\n  log_it(x);\n}\n#endif\nint common(int x)\n{\n}\n",
    "app/store.ios.ts": "export function save(x) {\n  keychain(x)\n}\n",
    "app/store.android.ts": "export function save(x) {\n  keystore(x)\n}\n",
    "app/only.web.ts": "export function draw(x) {\n}\n",
    "src/dir.rs": '#[cfg(windows)]\nfn config_dir(x: i32) {\n    known_folder(x);\n}\n#[cfg(not(windows))]\nfn config_dir(x: i32) {\n    xdg(x);\n}\n#[cfg(target_os = "linux")]\nfn tray(x: i32) {\n}\n',
    "src/a.swift": "#if os(iOS)\nfunc show(x: Int) {\n}\n#else\nfunc show(x: Int) {\n}\n#endif\n",
}
ALL = {"windows", "linux", "android", "macos", "ios", "web"}


def test_targets_variants_and_divergences(spark):
    df = spark.createDataFrame(list(TREE.items()), "path string, text string").repartition(2)
    tree = V.Tree.of(df)
    got = {(r["path"].split("/")[1], r["qualified"], r["start"]): (set(r["targets"]), set(r["unknown"])) for r in V.placed(df, tree).collect()}
    assert got == {
        ("io.c", "load", 2): ({"windows"}, set()),
        ("io.c", "load", 7): ({"macos", "ios"}, set()),
        ("io.c", "sound", 14): ({"linux", "android", "web"}, {"linux", "android", "web"}),
        ("io.c", "load", 18): ({"linux", "android", "web"}, set()),
        ("io.c", "common", 24): (ALL, set()),
        ("store.ios.ts", "save", 1): ({"ios"}, set()),
        ("store.android.ts", "save", 1): ({"android"}, set()),
        ("only.web.ts", "draw", 1): ({"web"}, set()),
        ("dir.rs", "config_dir", 2): ({"windows"}, set()),
        ("dir.rs", "config_dir", 6): (ALL - {"windows"}, set()),
        ("dir.rs", "tray", 10): ({"linux", "android"}, set()),
        ("a.swift", "show", 2): ({"ios"}, set()),
        ("a.swift", "show", 5): (ALL - {"ios"}, set()),
    }
    groups = {(r["grp"], r["start"]) for r in V.variants(V.placed(df, tree)).collect()}
    assert groups == {("function:src/io.c#load", 2), ("function:src/io.c#load", 7), ("function:src/io.c#load", 18), ("function:app/store.ts#save", 1), ("function:src/dir.rs#config_dir", 2), ("function:src/dir.rs#config_dir", 6), ("function:src/a.swift#show", 2), ("function:src/a.swift#show", 5)}
    found = {(r["grp"].split("#")[1], r["kind"], r["what"]) for r in V.divergences(df, tree).collect()}
    assert found == {("load", "own-calls", "win_open"), ("load", "own-calls", "mac_open"), ("load", "own-calls", "posix_open"), *(("save", "own-calls", c) for c in ("keychain", "keystore")), *(("save", "missing-target", t) for t in ALL - {"ios", "android"}), ("config_dir", "own-calls", "known_folder"), ("config_dir", "own-calls", "xdg")}


def test_an_empty_tree(spark):
    df = spark.createDataFrame([], "path string, text string")
    assert V.placed(df).collect() == [] == V.divergences(df).collect()
