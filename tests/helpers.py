"""Small trace files and their tables."""

import json


def event(run, step, kind, payload=None, ts=None, **more):
    return {"schema": "t", "run_id": run, "step_id": step, "ts": ts if ts is not None else 100.0 + step, "type": kind, "payload": {} if payload is None else payload, **more}


def write_lines(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines), encoding="utf-8")
    return f"file://{path}"


def by(df, *keys):
    """Rows as dicts by key."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict(recursive=True) for r in df.collect()}
