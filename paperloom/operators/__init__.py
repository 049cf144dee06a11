"""Table operators shared by the jobs: lookups, modes, numbering, collisions."""
