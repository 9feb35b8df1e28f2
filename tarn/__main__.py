"""Shell: python -m tarn [--load DIR] [--source http]; type help for its commands."""

from __future__ import annotations

import argparse
import sys

from tarn.api import Engine, timed_search
from tarn.operators.frontier import MAX_DEPTH, MAX_PAGES, CrawlOptions
from tarn.plans.session import local_session
from tarn.sources.pages import HttpSource, StubSource

HELP = "search TEXT | crawl URL | save DIR | load DIR | save-sealed DIR PASSWORD | load-sealed DIR PASSWORD | status | activity | exit"


def run(engine: Engine, line: str) -> str:
    """One command's output; a line that is no command is a search."""
    command, _, rest = line.strip().partition(" ")
    rest = rest.strip()
    if command == "help":
        return HELP
    if command == "status":
        return engine.status_json()
    if command == "activity":
        return "\n".join(f"{r.ts} {r.kind} {r.url} {r.text}" for r in engine.dashboard()["activity"].collect())
    if command == "crawl":
        done = engine.crawl([rest])
        return f"{done.crawled} pages, {done.counts}"
    if command in ("save", "load") and rest:
        return str(getattr(engine, command)(rest) or "loaded")
    if command in ("save-sealed", "load-sealed") and len(rest.split()) == 2:
        path, password = rest.split()
        (engine.save_encrypted if command == "save-sealed" else engine.load_encrypted)(path, password)
        return "done"
    hits, ms = timed_search(engine, rest if command == "search" else line)
    return "\n".join(f"{h.rank}. [{h.source}] {h.title} {h.url} {h.score:.4f}" for h in hits) + f"\n{len(hits)} hits in {ms:.0f} ms"


def main() -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--load", help="directory of a saved index")
    options.add_argument("--cores", default="4")
    options.add_argument("--source", choices=("stub", "http"), default="stub", help="where pages come from")
    options.add_argument("--proxy", help="SOCKS5 endpoints of the http source, host:port separated by commas")
    options.add_argument("--retries", type=int, default=2, help="tries after a transient error")
    options.add_argument("--max-pages", type=int, default=MAX_PAGES)
    options.add_argument("--max-depth", type=int, default=MAX_DEPTH)
    options.add_argument("--ignore-robots", action="store_true")
    chosen = options.parse_args()
    proxies = [(h or "127.0.0.1", int(p)) for h, _, p in (x.strip().rpartition(":") for x in (chosen.proxy or "").split(",")) if p]
    source = HttpSource(retries=chosen.retries, proxies=proxies) if chosen.source == "http" else StubSource()
    limits = CrawlOptions(max_pages=chosen.max_pages, max_depth=chosen.max_depth, obey_robots=not chosen.ignore_robots)
    engine = Engine(local_session(chosen.cores), source, limits)
    if chosen.load:
        engine.load(chosen.load)
    else:
        engine.seed()
    for line in sys.stdin:
        if line.strip() in ("exit", "quit"):
            break
        if line.strip():
            print(run(engine, line), flush=True)


if __name__ == "__main__":
    main()
