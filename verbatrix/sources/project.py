"""Settings, selectors and package metadata: small files that the driver reads."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path
from urllib.parse import urlsplit

from verbatrix.errors import EngineError
from verbatrix.operators.acquire import Policy

CONFIG = "verbatrix.toml"
POLICY = "verbatrix.policy.json"
PREFERRED = ("types", "typings", "import", "require", "default")
SUFFIXES = ("", ".d.ts", ".ts", ".tsx", ".js", ".mjs", ".cjs")
INDEX_FILES = ("index.d.ts", "index.ts", "index.tsx", "index.js", "index.mjs", "index.cjs")


def find_config(start: str = ".") -> Path | None:
    here = Path(start).resolve()
    return next((p / CONFIG for p in (here, *here.parents) if (p / CONFIG).is_file()), None)


def load_config(start: str = ".") -> dict:
    """Settings of the nearest configuration file; none if it can't be read."""
    path = find_config(start)
    try:
        return tomllib.loads(path.read_text()) if path else {}
    except (OSError, tomllib.TOMLDecodeError):
        return {}


def with_defaults(flags: dict, config: dict) -> dict:
    """``flags`` with what the configuration says where they are silent."""
    text = lambda v: v.strip() if isinstance(v, str) and v.strip() else None
    fallback = {
        "json": True if str(config.get("output", "")).lower() == "json" else None, "index": text(config.get("index_path")), "path": text(config.get("manifest_path")),
        "policy": text((config.get("trust") or {}).get("policy")), "indexes": ",".join(map(str, (config.get("federation") or {}).get("indexes") or [])) or None,
    }
    return {k: v for k, v in fallback.items() if v is not None and not flags.get(k)} | {k: v for k, v in flags.items() if v or k not in fallback}


def positive(value, default: int) -> int:
    """Leading digits of ``value`` as a positive number, else the default."""
    found = re.match(r"\s*[+]?(\d+)", str(value if value is not None else ""))
    return int(found[1]) if found and int(found[1]) > 0 else default


def load_policy(path: str = "") -> Policy:
    target = Path(path or POLICY)
    if not target.exists():
        return Policy()
    try:
        raw = json.loads(target.read_text())
    except ValueError as e:
        raise EngineError("INVALID_ARGS", f"policy is not JSON: {target}", "fix its syntax") from e
    names = lambda k, d: tuple(str(x) for x in raw[k]) if isinstance(raw.get(k), list) else d
    base = Policy()
    return Policy(names("allowed_hosts", ()), names("blocked_hosts", ()), tuple(x.lower() for x in names("allowed_extensions", base.allowed_extensions)), positive(raw.get("max_files"), base.max_files), positive(raw.get("max_total_bytes"), base.max_total_bytes))


def require_host(url: str, policy: Policy) -> None:
    host = (urlsplit(url).hostname or "").lower()
    if not host:
        raise EngineError("INVALID_ARGS", f"invalid URL: {url}", "pass an http(s) URL")
    if host in {h.lower() for h in policy.blocked_hosts}:
        raise EngineError("FETCH_BLOCKED", f"blocked host: {host}", "see blocked_hosts of the policy")
    if policy.allowed_hosts and host not in {h.lower() for h in policy.allowed_hosts}:
        raise EngineError("FETCH_BLOCKED", f"host not allowed: {host}", "see allowed_hosts of the policy")


def parse_selector(selector: str) -> dict | None:
    """What a selector names: npm package, repository, local path or documentation URL."""
    value = (selector or "").strip()
    if not value:
        return None
    if value.startswith("npm:"):
        return {"type": "npm", "package_name": value[4:]}
    if short := re.fullmatch(r"(?i)github:([^/]+)/([^#\s]+)", value):
        return {"type": "github", "owner": short[1], "repo": short[2]}
    if Path(value).exists():
        return {"type": "local_dir" if Path(value).is_dir() else "local_file", "path": str(Path(value).resolve())}
    url = urlsplit(value)
    if url.scheme and (url.netloc or url.path) and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value):
        parts = [p for p in url.path.split("/") if p]
        if url.hostname == "github.com" and len(parts) >= 2:
            return {"type": "github", "owner": parts[0], "repo": re.sub(r"(?i)\.git$", "", parts[1])}
        return {"type": "docs_url", "url": value}
    return {"type": "npm", "package_name": value}


def parse_symbol_ref(ref: str) -> tuple[str, str]:
    """Selector and symbol of ``selector#symbol``."""
    selector, _, symbol = (ref or "").partition("#")
    return selector.strip(), symbol.strip()


def parse_refs(value: str) -> list[str]:
    return list(dict.fromkeys(x.strip() for x in (value or "").split(",") if x.strip()))


def package_meta(folder: str) -> dict:
    try:
        raw = json.loads((Path(folder) / "package.json").read_text())
    except (OSError, ValueError):
        raw = {}
    return {"name": raw.get("name") or Path(folder).name, "version": raw.get("version") or "local", "json": raw if isinstance(raw, dict) else {}}


def _exported(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [p for v in value for p in _exported(v)]
    if not isinstance(value, dict):
        return []
    return [value[k] for k in PREFERRED if isinstance(value.get(k), str)] + [p for k in sorted(set(value) - set(PREFERRED)) for p in _exported(value[k])]


def _existing(folder: Path, raw: str) -> Path | None:
    full = folder / raw.removeprefix("./")
    return next((p for p in (*(Path(f"{full}{s}") for s in SUFFIXES), *(full / n for n in INDEX_FILES)) if p.is_file()), None)


def package_entries(folder: str) -> list[str]:
    """Entry files of a package, relative to it, in the order in which they count."""
    base, raw = Path(folder), package_meta(folder)["json"]
    named = _exported(raw.get("exports")) + [str(raw[k]) for k in ("types", "typings", "module", "main") if raw.get(k)] + ["index.d.ts", "dist/index.d.ts", "src/index.ts", "index.js"]
    found = [p.resolve().relative_to(base.resolve()).as_posix() for n in named if (p := _existing(base, n)) and p.resolve().is_relative_to(base.resolve())]
    return list(dict.fromkeys(found))


def local_package(name: str, start: str = ".") -> str | None:
    """Nearest ``node_modules`` folder of a package above ``start``."""
    here = Path(start).resolve()
    return next((str(p / "node_modules" / name) for p in (here, *here.parents) if (p / "node_modules" / name).is_dir()), None)


def require_within(folder: str | Path, target: str | Path) -> Path:
    """``target`` with links and dots resolved. Raises unless it is ``folder`` or lies under
    it; whole names are compared, so that a sibling whose name starts like the folder's is outside."""
    root, path = Path(folder).resolve(), Path(target).resolve()
    if not path.is_relative_to(root):
        raise EngineError("POLICY_VIOLATION", f"{path} lies outside of {root}", "Give a target under the snapshot's folder")
    return path
