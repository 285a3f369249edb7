"""Small sources and a patch whose symbols and hunks are known by eye."""

PYTHON = '''import json
import pathlib as pl


@app.get("/users/{user_id}")
async def read_user(user_id: str, *fields, depth: int = 1, **more) -> dict:
    """One user."""
    data = json.loads(pl.Path(user_id).read_text())
    return trim(data, depth)


def trim(data, depth):
    def inner(x):
        return x
    return inner(data)


class Store:
    def save(self, user):
        return trim(user, 1)


limit = 10
if limit:
    print(trim({}, limit))
'''
BROKEN = "def fine():\n    return 1\n\nif broken:\n"
JAVA = "class Box {\n  Box() { }\n  int size(int a) { if (a > 0) { return a; } return 0; }\n  abstract void none();\n  class In { void deep() { } }\n}\n"
SCRIPT = "/** Adds. */\nexport function add(a: number) { return `${a}{`; }\nconst arrow = () => 1;\nclass Svc {\n  async run(q: string): Promise<void> { return add(1); }\n  #hid() { return 1; }\n}\n"
PATCH = """diff --git a/app.py b/app.py
--- a/app.py
+++ b/app.py
@@ -11,5 +11,5 @@ def read_user
 
 def trim(data, depth):
     def inner(x):
-        return x or None
+        return x
     return inner(data)
@@ -21,4 +21,3 @@ class Store
 
 limit = 10
--- limit
 if limit:
"""
