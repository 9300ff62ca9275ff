"""Cell-level Column builders."""
