"""Resolving links. Written as SQL text: it nests in other SQL by name, and a plan
that resolves links in several places builds the expression with one call each."""

from __future__ import annotations

_ORIGIN = "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"

# What links are relative to: the parts of a page's URL, computed once per page.
_PARTS = """
named_struct(
  'url', {url},
  'origin', regexp_extract({url}, r'{origin}', 1),
  'scheme', regexp_extract({url}, r'^([A-Za-z][A-Za-z0-9+.-]*:)//', 1),
  'path', regexp_extract({url}, r'{origin}([^?#]*)', 2),
  'folder', regexp_replace(regexp_extract({url}, r'{origin}([^?#]*)', 2), r'[^/]*$', ''))"""

# Which origin and path a reference means; `u` is set where it is not a path at all.
_TARGET = """
CASE
  WHEN {r} RLIKE r'^(?i)https?://' THEN
    named_struct('u', CAST(null AS STRING), 'o', regexp_extract({r}, r'{origin}', 1),
                 'p', substr({r}, length(regexp_extract({r}, r'{origin}', 1)) + 1))
  WHEN {r} RLIKE r'^[A-Za-z][A-Za-z0-9+.-]*:' THEN named_struct('u', {r}, 'o', '', 'p', '')
  WHEN {b}.origin = '' THEN named_struct('u', '', 'o', '', 'p', '')
  WHEN {r} = '' THEN named_struct('u', {b}.url, 'o', '', 'p', '')
  WHEN startswith({r}, '//') THEN named_struct('u', {b}.scheme || {r}, 'o', '', 'p', '')
  WHEN startswith({r}, '/') THEN named_struct('u', null, 'o', {b}.origin, 'p', {r})
  WHEN startswith({r}, '?') THEN named_struct('u', {b}.origin || {b}.path || {r}, 'o', '', 'p', '')
  WHEN startswith({r}, '#') THEN
    named_struct('u', substring_index({b}.url, '#', 1) || {r}, 'o', '', 'p', '')
  ELSE named_struct('u', null, 'o', {b}.origin,
                    'p', if({b}.folder = '', '/', {b}.folder) || {r})
END"""

# Dot segments leave the path; further ones at the root are dropped.
_TIDY = """
CASE
  WHEN t.u IS NOT NULL THEN t.u
  WHEN t.p RLIKE r'^[^?#]*/[.]' THEN t.o || transform(
    array(split(regexp_extract(t.p, r'^([^?#]*)', 1), '/')),
    segs -> transform(
      array(aggregate(
        slice(segs, 2, size(segs)), CAST(array() AS ARRAY<STRING>),
        (kept, seg) -> CASE
          WHEN seg = '.' THEN kept
          WHEN seg = '..' THEN slice(kept, 1, greatest(size(kept) - 1, 0))
          ELSE concat(kept, array(seg)) END)),
      done -> concat('/', array_join(done, '/'),
                     if(element_at(segs, -1) IN ('.', '..') AND size(done) > 0, '/', '')))[0])[0]
    || regexp_extract(t.p, r'^[^?#]*(.*)$', 1)
  ELSE t.o || t.p
END"""


def base_parts(url: str) -> str:
    """SQL for the parts of the URL that ``url`` (SQL text) gives."""
    return _PARTS.format(url=url, origin=_ORIGIN)


def absolute_url(base: str, ref: str) -> str:
    """SQL for ``ref`` resolved against ``base`` parts; empty where it cannot be."""
    target = _TARGET.format(r="r", b=base, origin=_ORIGIN)
    return (
        f"coalesce(transform(transform(array(trim({ref})), r -> {target}), t -> {_TIDY})[0], '')"
    )
