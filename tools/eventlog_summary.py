"""Summarise a Spark event log: the longest jobs and stages.

usage: python tools/eventlog_summary.py <event-log-file-or-folder> [top]
"""

from __future__ import annotations

import io
import json
import os
import sys


def events(path: str):
    files = [os.path.join(root, f) for root, _, fs in os.walk(path) for f in fs] if os.path.isdir(path) else [path]
    for f in sorted(files):
        if os.path.basename(f).startswith("appstatus"):
            continue
        if f.endswith(".zstd"):
            import zstandard
            raw = open(f, "rb")
            fh = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
        else:
            fh = open(f, encoding="utf-8")
        with fh:
            for line in fh:
                if line.startswith("{"):
                    yield json.loads(line)


def main() -> None:
    path, top = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 15
    jobs, stages = {}, []
    for e in events(path):
        kind = e.get("Event")
        if kind == "SparkListenerJobStart":
            props = e.get("Properties") or {}
            jobs[e["Job ID"]] = {"start": e["Submission Time"], "desc": props.get("callSite.short", ""),
                                 "stages": len(e.get("Stage IDs", []))}
        elif kind == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]]["end"] = e["Completion Time"]
        elif kind == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            if "Submission Time" in info and "Completion Time" in info:
                stages.append((info["Completion Time"] - info["Submission Time"], info["Stage ID"],
                               info["Number of Tasks"], info["Stage Name"][:70]))
    done = [(j["end"] - j["start"], jid, j["stages"], j["desc"][:70]) for jid, j in jobs.items() if "end" in j]
    print(f"jobs: {len(done)}  total job time: {sum(d[0] for d in done) / 1000:.1f}s")
    for ms, jid, ns, desc in sorted(done, reverse=True)[:top]:
        print(f"  job {jid:4d} {ms / 1000:6.2f}s stages={ns:2d} {desc}")
    print(f"stages: {len(stages)}")
    for ms, sid, nt, name in sorted(stages, reverse=True)[:top]:
        print(f"  stage {sid:4d} {ms / 1000:6.2f}s tasks={nt:4d} {name}")


if __name__ == "__main__":
    main()
