"""Training-data operators: mixing, quality, deduplication, scanning, extraction, search, packing.

Nothing outside this subpackage imports it; deleting it leaves the rest of the
package, its queries and its tests untouched.
"""
