"""Operators for large training corpora; `queries` in `registry` names their queries."""
