"""Log lines and files for tests, and the small test tables."""

import json
import os

SF_SMALL = "/root/testdata/sf0.001"


def record(uuid="m-1", parent=None, content="An opening line", ts="2031-03-05T04:06:07.089Z", role="user", **over):
    r = {"parentUuid": parent, "isSidechain": False, "userType": "tester", "cwd": "/home/t",
         "sessionId": "s-9", "version": "7.8.9", "gitBranch": "trunk", "type": role,
         "message": {"role": role, "content": content}, "uuid": uuid, "timestamp": ts}
    r.update(over)
    return json.dumps(r, ensure_ascii=False)


def write_file(path, lines, newline="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(newline.join(lines) + newline)


def files_opened(df, column):
    """The numFiles metric of the scans of ``column`` in a plan that has run."""
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "FileSourceScanExec" and column in node.toString():
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))
        for inner in ("AdaptiveSparkPlanExec", "QueryStage"):
            if inner in node.getClass().getSimpleName():
                walk(node.executedPlan() if inner.startswith("Adaptive") else node.plan())

    walk(df._jdf.queryExecution().executedPlan())
    return found
