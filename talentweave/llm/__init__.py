"""Training-data operators over `documents`, `benchmark` and `conversations`; nothing outside this subpackage imports it."""
