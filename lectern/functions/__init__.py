"""Part of the library; see the README for what each module holds."""
