"""Settings that the incremental jobs share: the curation stream (J1, ``ledger``) and the progress of runs (J2, ``progress``)."""

BYTES_PER_TRIGGER = 16 << 30
