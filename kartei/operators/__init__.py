"""Set-oriented operators over the catalogue: diff, coalescing, eligibility, rules, mutations."""
