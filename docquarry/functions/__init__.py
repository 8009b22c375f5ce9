"""Functions on JSON values: kinds, paths, order, patches."""
