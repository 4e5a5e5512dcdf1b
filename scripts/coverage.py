"""Print the registered queries as a markdown table: name, check type, what it covers."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelcast.plans import registry  # noqa: E402

registry.load_all()
print("| query | check | covers |")
print("| --- | --- | --- |")
for name, fn in registry.QUERIES.items():
    doc = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
    kind = "SQL twin" if name in registry.ORACLE else "rows-only"
    print(f"| `{name}` | {kind} | {doc} |")
print(f"\n{len(registry.QUERIES)} queries, {len(registry.ORACLE)} with a SQL twin.")
